"""MinHash near-dedup with sequential Bayesian verification.

Each text is read once into its distinct shingle count, a digest of its shingle set and a MinHash signature. Texts with equal sets are one
class, and only one row of each class goes on. Signatures are banded; classes that share a band are candidates. Candidates are compared
batch by batch of their signatures, and a pair is dropped as soon as the posterior probability that its similarity reaches the
threshold is below MISS. What survives is verified on the full shingle sets, and verified links are joined to components.

No group is expanded into all its pairs. In a band's bucket every member is compared with one leader. Links found make components, and only
buckets that still hold several components go on: first with their most central members as leaders; then all pairs across components
of small buckets are compared, by a bit of each signature value and by parity sketches before anything else. Large ones take another leader in each
round while that brings links, which only makes components fewer: at last they are split into blocks, and every block meets every other, so that all
their pairs across components are compared as well. Within a task a bucket is reduced to its leader and a few members before the shuffle.

A pair at the threshold is lost where it shares no band (6e-5), where one of its 12 batches of signature values rules it out (1e-5 each at most, counted
with a uniform prior), and, if no link of the first rounds has joined it, where the bits of its signatures do (1e-5): 2e-4 in all at most, and
far less for pairs beyond the threshold. Parity sketches never rule out a link.

Defined cases: null and empty texts (and white space alone) have the empty set, n_shingles 0, and link with nothing; their component_id is their own
doc_id. Texts of fewer than k words have one shingle, their whole sequence. Rows that share a doc_id are one document: whatever their texts link
with is one component. Rows without a doc_id are told apart by their texts and link like others; where no row of a component has one, component_id is
null and all of its rows are kept. Repeated rows give repeated rows with the same component. ids that aren't whole numbers are an error. Very long texts are
read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs as B
from . import kernel as K
from .components import components
from .parity import LongParities
from .shared import bounded_batches, discard, fresh, integer_ids, parts, ranges, staged, text_or_empty

_U = np.uint64
#: Bands and rows of each: a pair at 0.75 shares a band with probability 0.99994, one at 0.2 with 0.01.
BANDS, ROWS = 36, 5
#: Similarity of a link, in percent; shingle size; probability below which a candidate is given up; signature values a batch.
SIMILAR, SHINGLE, MISS, BATCH = 75, 5, 1e-5, 16
#: Members up to which a bucket's pairs across components are all compared, by bits of their signatures first.
SMALL = 4096
#: Round at the latest in which large buckets are compared in full; before it they take leaders as long as one brings a link.
ROUNDS = 12
#: Members of a block of a large bucket, about, and of a tile of two blocks; entries of all bands that a range of buckets holds, about.
BLOCK, TILE, ENTRIES = 4096, 512, 4_000_000
#: Pairs that are looked up in the long parities at once.
MANY = 1 << 17


def _multipliers(n: int, seed: int = 71) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least values of len(a) hash functions over the set h, taken a block at a time."""
    x = (h >> _U(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        v = x[i : i + 256, None] * a
        v += b
        np.minimum(out, v.min(0), out=out)
    return out


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, digest of the text, n_shingles, d1 and d2 (digest of the set) and signature of every row."""
    bounded_batches(docs.sparkSession)
    a, b = _multipliers(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sig = [], [], [], []
            for _, _, data, offs in K.chunks(batch.column("text")):
                h, at = K.shingle_sets(K.lowered(data), offs, k)
                c1, c2 = (np.concatenate([np.zeros(1, _U), np.cumsum(K.mix(h ^ _U(s)))]) for s in (0x1234567, 0x89ABCDEF01))
                n.append(np.diff(at))
                d1.append((c1[at[1:]] - c1[at[:-1]]).view(np.int64))
                d2.append((c2[at[1:]] - c2[at[:-1]]).view(np.int64))
                sig += [signature(h[x:y], a, b).tobytes() if y > x else b"" for x, y in zip(at[:-1], at[1:], strict=True)]
            cat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), cat(n), cat(d1), cat(d2), pa.array(sig, pa.binary())], names=["doc_id", "digest", "n_shingles", "d1", "d2", "sig"])

    integer_ids(docs, id_column)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_column)).alias("digest"), text_or_empty(text_column).alias("text"))
    return texts.mapInArrow(run, "doc_id long, digest long, n_shingles long, d1 long, d2 long, sig binary")


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes of each band's values, other for each band."""
    v = sig.reshape(len(sig), bands, rows).astype(_U)
    out = np.broadcast_to(K.mix(np.arange(bands).astype(_U) + _U(1)), v.shape[:2]).copy()
    for r in range(rows):
        out = K.mix(out ^ v[:, :, r])
    return out


def _grouped(key: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, bounds of the groups in it, and which groups have more than one label."""
    order = np.argsort(key)
    s, of = key[order], labels[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, np.int64)
    mixed = np.minimum.reduceat(of, new[:-1]) != np.maximum.reduceat(of, new[:-1]) if len(s) else np.zeros(0, bool)
    return order, new, mixed


def _groups(order: np.ndarray, new: np.ndarray, mixed: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of each group that has more than one label."""
    for g in np.flatnonzero(mixed):
        yield order[new[g] : new[g + 1]]


def _stars(order: np.ndarray, new: np.ndarray, mixed: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first round: (least id, other id) of each group, and which places of the order stand for their group."""
    own, size = ids[order], np.diff(new)
    first = np.zeros(len(own), bool)
    if not len(own):
        return own, own, first
    lead = np.repeat(np.minimum.reduceat(own, new[:-1]), size)
    other = (own != lead) & np.repeat(mixed, size)
    at = np.flatnonzero(own == lead)
    groups = np.repeat(np.arange(len(size)), size)[at]
    first[at[np.concatenate([[True], groups[1:] != groups[:-1]])]] = True
    return lead[other], own[other], first


def least_bits(n: int, threshold: float, miss: float) -> int:
    """Fewest equal bits of n with which a pair at the threshold goes on: fewer come with a probability below `miss`."""
    p, below = (1 + threshold) / 2, 0.0
    for m in range(n + 1):
        below += comb(n, m) * p**m * (1 - p) ** (n - m)
        if below >= miss:
            return m
    return n


def bit_sketches(batch: pa.RecordBatch, values: int, threshold: float = SIMILAR / 100, miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
    """A bit of each signature value, as 64-bit words, and the bits in which a pair may differ."""
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, values)
    bits = np.packbits((sig & np.uint32(256)) > 0, axis=1)
    wide = np.zeros((len(sig), -(-values // 64) * 8), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return wide.view(_U), np.full(len(sig), values - least_bits(values, threshold, miss), np.int64)


class _Bucket:
    """Pairs across labels of one bucket in a later round. A pair whose sketches differ in more bits than half the sum of their allowances is left
    out. Round 1: the two most central members with all others. Round 2: all pairs, if the bucket is small. From round 3 on: in large buckets only, a pseudo-random leader with all others."""

    def __init__(self, round_: int, small: int, refine=None):
        self.round, self.small, self.refine = round_, small, refine

    def rank(self, ids: np.ndarray, key: int) -> np.ndarray:
        return K.mix(ids.view(_U) ^ _U((key + self.round * 0x9E37) & 0xFFFFFFFFFFFFFFFF))

    def star(self, lead: int, labels: np.ndarray, bits: np.ndarray, allow: np.ndarray) -> np.ndarray:
        """Members that go on with a leader."""
        near = 2 * np.bitwise_count(bits ^ bits[lead]).sum(1, dtype=np.int64) <= allow + allow[lead]
        return np.flatnonzero(near & (labels != labels[lead]))

    def pairs(self, ids: np.ndarray, labels: np.ndarray, key: int, bits: np.ndarray, allow: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        small = whole and len(ids) <= self.small
        if small and self.round == 2:
            return self.all(ids, labels, bits, allow)
        if small and self.round > 2:
            return ids[:0], ids[:0]
        if self.round == 1:
            seen = bits[:: max(1, len(ids) // 48)]
            far = np.zeros(len(ids), np.int64)
            for x in seen:
                far += np.bitwise_count(bits ^ x).sum(1, dtype=np.int64)
            leads = np.argsort(far, kind="stable")[:2]
        else:
            leads = [np.argmin(self.rank(ids, key))]
        got = [self.star(x, labels, bits, allow) for x in leads]
        return np.concatenate([np.full(len(g), ids[x]) for x, g in zip(leads, got, strict=True)]), np.concatenate([ids[g] for g in got])

    def all(self, ids: np.ndarray, labels: np.ndarray, bits: np.ndarray, allow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A block of rows at a time."""
        a, b = [], []
        for lo in range(0, len(ids), 256):
            rows = slice(lo, lo + 256)
            i, j = np.nonzero(np.triu(labels[rows, None] != labels[None, lo:], 1))
            keep = np.flatnonzero(2 * np.bitwise_count(bits[rows][i] ^ bits[lo:][j]).sum(1, dtype=np.int64) <= allow[rows][i] + allow[lo:][j])
            x, y = ids[rows][i[keep]], ids[lo:][j[keep]]
            if self.refine and len(x) > MANY:
                keep = self.refine(x, y)
                x, y = x[keep], y[keep]
            a.append(x)
            b.append(y)
        return np.concatenate(a), np.concatenate(b)


class _Pairs:
    """Distinct pairs, the lesser id first; those of round 2 that `refine` rules out are left out, many at once and each once."""

    def __init__(self, refine):
        self.refine, self.new, self.n, self.kept = refine, [], 0, np.zeros((0, 2), np.int64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            self.new.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            self.n += len(x)
            if self.n > 8 * MANY:
                self.flush()

    def flush(self) -> np.ndarray:
        if self.new:
            got = np.unique(np.concatenate(self.new), axis=0)
            if self.refine:
                got = got[self.refine(got[:, 0].copy(), got[:, 1].copy())]
            self.kept = np.unique(np.concatenate([self.kept, got]), axis=0)
            self.new, self.n = [], 0
        return self.kept


def candidates(classes: DataFrame, round_: int, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, sketches=None, words: int = -(-BANDS * ROWS // 64), refine=None, only: np.ndarray | None = None, read=None, n: int | None = None) -> DataFrame:
    """classes: id, label, sig, and what `sketches` reads. Pairs (a, b) of different labels that share a band and go on in this round.

    Round 0 gives each class that shares a band one pair only, that with the least id; what that leaves open is for the later rounds, among
    the classes that share a band with another at all. sketches(batch) gives `words` 64-bit words and an allowance for each row; refine(a, b) tells which pairs of ids may still be links.
    read(batches) may take the place of the columns: it gives ids, labels, signatures, sketches and allowances. n: ranges of the buckets.
    Round 2 gives as `large`, without a pair, the key of each bucket of several labels that is too large for it; the rounds after it take these keys (sorted) as `only`."""
    n = n or parts(classes.sparkSession)
    bucket = _Bucket(round_, small, refine)
    sketches = sketches or (lambda b: bit_sketches(b, bands * rows))
    none = (np.zeros((0, words), _U), np.zeros(0, np.int64))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, bands * rows)
            yield b.column("id").to_numpy(), b.column("label").to_numpy(), sig, *(sketches(b) if round_ else none)

    def edges(x: np.ndarray, y: np.ndarray) -> bytes:
        order = np.argsort(x)
        return b"e" + B.pack(x[order].view(_U), y[order].view(_U))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, bands), _U), *none)]
        for ids, labels, sig, *rest in (read or columns)(batches):
            got.append((ids, labels, band_keys(sig, bands, rows), *rest))
        ids, labels, keys, bits, allow = (np.concatenate(x) for x in zip(*got, strict=True))
        key, at = keys.ravel(), np.repeat(np.arange(len(ids)), bands)  # all bands at once: their hashes differ
        del keys, got
        if only is not None:
            mine = _within(key, only)
            key, at = key[mine], at[mine]
        order, new, mixed = _grouped(key, labels[at])
        if round_:
            ea, eb, cut, send = [], [], [], np.ones(len(key), bool)
            for g in np.flatnonzero(mixed & (np.diff(new) > small)):
                own, k = at[order[new[g] : new[g + 1]]], int(key[order[new[g]]])
                x, y = bucket.pairs(ids[own], labels[own], k, bits[own], allow[own], whole=False)
                ea.append(x)
                eb.append(y)
                cut.append(k)
                send[new[g] : new[g + 1]] = False
                send[new[g] + np.argsort(bucket.rank(ids[own], k), kind="stable")[: small + 1]] = True
            x, y = (np.concatenate([ids[:0], *e]) for e in (ea, eb))
            if cut and round_ == 2:
                yield B.rows([(cut[0] % n, b"l" + B.pack(np.sort(np.array(cut, _U))))])
        else:
            x, y, send = _stars(order, new, mixed, ids[at])
        order = order[send]
        bounds = np.searchsorted(B.bucket_of(key[order], n), np.arange(n + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            f = order[bounds[k] : bounds[k + 1]]
            p = at[f]
            rest = (labels[p].view(_U), allow[p].astype(_U), *bits[p].T) if round_ else ()  # at first each class is its own label
            yield B.rows([(k, b"k" + B.pack(key[f], ids[p].view(_U), *rest))])
        if len(x):
            yield B.rows([(int(x[0]) % n, edges(x, y))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, pairs = [], [], _Pairs(refine if round_ == 2 else None)
        for batch in batches:
            for blob in batch.column("blob"):
                raw = blob.as_py()
                if raw[:1] == b"e":
                    x, y = B.unpack(raw[1:], 2)
                    pairs.add(x.view(np.int64), y.view(np.int64))
                elif raw[:1] == b"l":
                    large += B.unpack(raw[1:], 1)[0].tolist()
                else:
                    held.append(B.unpack(raw[1:], 4 + words if round_ else 2))
        if held:
            key, ids, *more = (np.concatenate(x) for x in zip(*held, strict=True))
            del held
            ids = ids.view(np.int64)
            labels = more.pop(0).view(np.int64) if round_ else ids
            order, new, mixed = _grouped(key, labels)
            if round_:
                allow, bits = more[0].view(np.int64), np.stack(more[1:], 1)
                for g in _groups(order, new, mixed):
                    if round_ == 2 and len(g) > small:
                        large.append(int(key[g[0]]))
                    pairs.add(*bucket.pairs(ids[g], labels[g], int(key[g[0]]), bits[g], allow[g]))
            else:
                pairs.add(*_stars(order, new, mixed, ids)[:2])
        keep = pairs.flush()
        for i in range(0, len(keep), 1 << 17):
            part = keep[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), pa.nulls(len(part), pa.int64())], names=["a", "b", "large"])
        if large:
            own = np.unique(np.array(large, _U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64()), pa.array(own)], names=["a", "b", "large"])

    dealt = classes.mapInArrow(deal, B.BLOB_ROWS)
    found = dealt.repartitionById(n, F.col("bucket")).mapInArrow(join, "a long, b long, large long")
    if round_ == 2:
        return found.distinct()
    found = found.select("a", "b")
    if round_:
        return found.distinct()
    ends = found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    ends = ends.groupBy(F.col("p.a").alias("x")).agg(F.min("p.b").alias("y"))
    return ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _within(key: np.ndarray, only: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ones."""
    return only[np.minimum(np.searchsorted(only, key), len(only) - 1)] == key if len(only) else np.zeros(len(key), bool)


def large_keys(found: DataFrame) -> np.ndarray:
    """Sorted keys of the large buckets that round 2 left open: one at most for each SMALL entries of buckets and task."""
    got = found.where("large is not null").select("large").distinct().toArrow().column("large").to_numpy()
    return np.sort(got.astype(np.int64).view(_U))


def across(classes: DataFrame, keys: np.ndarray, bands: int = BANDS, rows: int = ROWS, block: int | None = None, sketches=None, words: int = -(-BANDS * ROWS // 64), refine=None, n: int | None = None) -> DataFrame:
    """All pairs (a, b) of different labels that share one of the buckets in keys (sorted) and that neither sketches nor refine rule out.

    A bucket's members are dealt into blocks of about `block`, which lie in files that workers map, and each two blocks of a bucket meet in a
    row of their own: no task holds more than two blocks, and members move once, however large a bucket is."""
    spark, n = classes.sparkSession, n or parts(classes.sparkSession)
    block, root = block or BLOCK, fresh(spark, "blocks")
    sketches = sketches or (lambda b: bit_sketches(b, bands * rows))

    def entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Row, and place of its key in keys, of what lies in large buckets."""
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, bands * rows)
        key = band_keys(sig, bands, rows).ravel()
        at = np.flatnonzero(_within(key, keys))
        return at // bands, np.searchsorted(keys, key[at])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(len(keys), np.int64)
        for b in batches:
            got += np.bincount(entries(b)[1], minlength=len(keys))
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], names=["k", "n"])

    size = np.zeros(len(keys), np.int64)
    for r in classes.select("sig").mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        size[r["k"]] = r["n"]
    blocks = np.maximum(1, -(-size // block))
    first = np.cumsum(blocks) - blocks

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            row, k = entries(b)
            ids, labels, (bits, allow) = b.column("id").to_numpy()[row], b.column("label").to_numpy()[row], sketches(b)
            of = first[k] + (K.mix(ids.view(_U) ^ keys[k]) % blocks[k].astype(_U)).astype(np.int64)
            held.append((of, ids, labels, allow[row], *bits[row].T))
        if held:
            of, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((of, of % n))
            bounds = np.searchsorted((of % n)[order], np.arange(n + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                p = order[bounds[k] : bounds[k + 1]]
                yield B.rows([(k, B.pack(of[p].astype(_U), *(x[p].view(_U) for x in rest)))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [B.unpack(blob.as_py(), 4 + words) for batch in batches for blob in batch.column("blob")]
        if held:
            of, ids, labels, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((labels.view(np.int64), of))  # by label: tiles of one label are left out
            of = of[order].astype(np.int64)
            B.put(f"{root}/{of[0] % n}", ids[order], labels[order], rest[0][order], np.stack(rest[1:], 1)[order])
            own, at, many = np.unique(of, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(at), pa.array(many)], names=["block", "start", "n"])

    start, many, file = np.zeros(int(blocks.sum()), np.int64), np.zeros(int(blocks.sum()), np.int64), np.zeros(n, np.int64)
    dealt = classes.mapInArrow(deal, B.BLOB_ROWS).repartitionById(n, F.col("bucket"))
    for r in dealt.mapInArrow(write, "block long, start long, n long").collect():
        start[r["block"]], many[r["block"]] = r["start"], r["n"]
        file[r["block"] % n] += r["n"]

    def members(x: int) -> tuple[np.ndarray, ...]:
        if not many[x]:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros((0, words), _U),)
        raw, all_, lo, own = B.mapped(f"{root}/{x % n}"), int(file[x % n]), int(start[x]), int(many[x])
        one = [np.frombuffer(raw, np.int64, own, 8 * (c * all_ + lo)) for c in range(3)]
        return (*one, np.frombuffer(raw, _U, own * words, 8 * (3 * all_ + lo * words)).reshape(own, words))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = _tiles(members(x), members(y), x == y, refine)
                for lo in range(0, len(a), 1 << 17):
                    part = slice(lo, lo + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[part], b[part])), pa.array(np.maximum(a[part], b[part]))], names=["a", "b"])

    ends = spark.createDataFrame(list(zip(first.tolist(), (first + blocks - 1).tolist(), strict=True)), "lo long, hi long")
    ends = ends.select("hi", F.explode(F.sequence("lo", "hi")).alias("x")).select("x", F.explode(F.sequence("x", "hi")).alias("y"))
    return ends.repartition(max(1, min(8 * n, int((blocks * (blocks + 1) // 2).sum())))).mapInArrow(compare, "a long, b long").distinct()


def _tiles(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...], same: bool, refine) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of p's and q's members (ids, labels, allowances, sketches; sorted by label) of different labels that may be links."""
    (ids, labels, allow, bits), (ids2, labels2, allow2, bits2) = p, q
    a, b = [ids[:0]], [ids[:0]]
    for i in range(0, len(ids), TILE):
        u = slice(i, i + TILE)
        for j in range(i if same else 0, len(ids2), TILE):
            v = slice(j, j + TILE)
            lu, lv = labels[u], labels2[v]
            if lu[0] == lu[-1] == lv[0] == lv[-1]:
                continue
            far = np.zeros((len(lu), len(lv)), np.uint16)
            for w in range(bits.shape[1]):
                far += np.bitwise_count(bits[u, w, None] ^ bits2[None, v, w])
            near = (2 * far.astype(np.int64) <= allow[u, None] + allow2[None, v]) & (lu[:, None] != lv)
            x, y = np.nonzero(np.triu(near, 1) if same and i == j else near)
            x, y = ids[u][x], ids2[v][y]
            if refine and len(x):
                keep = refine(x, y)
                x, y = x[keep], y[keep]
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches among n signature values with which the posterior (uniform prior) that the similarity reaches the threshold is at least
    `miss`. A posterior Beta(m + 1, n - m + 1) exceeds t with the probability that n + 1 draws of chance t succeed at most m times."""
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def survivors(pairs: DataFrame, classes: DataFrame, threshold: float = SIMILAR / 100, miss: float = MISS, batch: int = BATCH) -> DataFrame:
    """Pairs that no batch of their signatures rules out, with their number of equal values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            alive, same = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i in range(0, x.shape[1], batch):
                same[alive] += (x[alive, i : i + batch] == y[alive, i : i + batch]).sum(1)
                alive = alive[same[alive] >= least_matches(min(i + batch, x.shape[1]), threshold, miss)]
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(alive)), b.column("b").take(pa.array(alive)), pa.array(same[alive])], names=["a", "b", "same"])

    left = classes.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, same long")


def verified(pairs: DataFrame, texts: DataFrame, similar: int = SIMILAR, k: int = SHINGLE) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity. texts: id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            sets = [_sets(b.column(c), k) for c in ("ta", "tb")]
            for i, (x, y) in enumerate(zip(*sets, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = len(x) > 0 and len(y) > 0 and 100 * both >= similar * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offs in K.chunks(texts):
        h, at = K.shingle_sets(K.lowered(data), offs, k)
        for x, y in zip(at[:-1], at[1:], strict=True):
            yield h[x:y]


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    spark, on = docs.sparkSession, ["n_shingles", "d1", "d2"]
    rows = staged(signed(docs, id_column=id_column, text_column=text_column), "signatures")
    full = rows.where("n_shingles > 0")
    groups, shared, repeated = _classes(full, on)
    chosen = groups.select(*on, "id", F.col("first").alias("_first"))
    one = full.join(chosen, on).where(F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["id"])
    classes = staged(one.select("id", "doc_id", "digest", "n_shingles", "sig"), "class_signatures")
    n = ranges(spark, BANDS * classes.count(), ENTRIES)
    pool = refine = large = None
    links = shared
    found, last, sketches = 0, False, lambda b: bit_sketches(b, BANDS * ROWS, similar / 100)
    labels = None
    for round_ in count():
        if round_:
            labelled = pool.join(labels, "id", "left").select("id", "sig", F.coalesce("component", "id").alias("label"))
        else:
            labelled = classes.withColumn("label", F.col("id"))
        if round_ == 2:
            refine = LongParities(pool, lambda texts: list(_sets(texts, SHINGLE)), similar, pool.count()).refine
        last = round_ > 2 and (not found or round_ >= ROUNDS)
        if last:
            pairs = staged(across(labelled, large, sketches=sketches, refine=refine, n=n), "candidates")
        else:
            pairs = staged(candidates(labelled, round_, sketches=sketches, refine=refine, only=large, n=n), "candidates")
        if round_ == 2:
            large = large_keys(pairs)
            last = not len(large)
        if pool is None:  # only classes that share a band with another go on
            ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            whole = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_column)).alias("digest"), text_or_empty(text_column).alias("text"))
            wanted = classes.join(ids, "id").select("id", F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "sig")
            pool = whole.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest"))).select("id", "text", "sig")
            pool = staged(pool.dropDuplicates(["id"]) if repeated else pool, "candidate_texts")
            discard(spark, classes)
        found = 0
        if round_ < 2 or not pairs.where("a is not null").isEmpty():
            alive = staged(survivors(pairs, pool, similar / 100), "survivors")
            new = staged(verified(alive, pool, similar).distinct(), "links")
            found = new.count()
            links = new if links is None else links.union(new)
            discard(spark, alive)
        discard(spark, pairs)
        if found or labels is None:
            labels = components(links)
        if last:
            break
    discard(spark, pool)
    named = groups.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    if shared is None:  # a class is named by its least id
        named = named.select(*on, F.col("component").alias("component_id"))
    else:
        least = staged(named.groupBy("component").agg(F.min("first").alias("component_id")), "component_ids")
        named = named.join(least, "component").select(*on, "component_id")
    out = rows.drop("sig", "digest").join(staged(named, "class_components"), on, "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _classes(full: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame | None, bool]:
    """Classes of equal sets with their least doc_id (`first`) and a number (`id`); links between classes that have a doc_id in common, None where a doc_id
    names each class; and whether any doc_id comes twice.

    A class is numbered by its least doc_id, unless rows of that have other texts as well or there is none: then by a hash of its set."""
    groups = full.groupBy(*on).agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nameless"))
    key = F.struct(*on)
    per_id = full.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))
    per_id = staged(per_id.where("n > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("several")), "repeated_ids")
    groups = staged(groups, "classes")
    repeated = not per_id.isEmpty() or not groups.where("nameless").isEmpty()
    several = per_id.where("several").select("doc_id")
    if not repeated or (several.isEmpty() and groups.where("first is null").isEmpty()):
        return groups.withColumn("id", F.col("first")), None, repeated
    marked = groups.join(several.select(F.col("doc_id").alias("first"), F.lit(True).alias("_several")), "first", "left")
    groups = staged(marked.select(*on, "first", F.when(F.col("first").isNull() | F.col("_several"), F.xxhash64(*on)).otherwise(F.col("first")).alias("id")), "numbered_classes")
    of = staged(full.join(several, "doc_id").join(groups.select(*on, "id"), on).select("doc_id", "id").distinct(), "ids_of_several")
    shared = of.join(of.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")
    return groups, staged(shared, "links"), repeated


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, 5-word shingles, similarity 75 % and more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
