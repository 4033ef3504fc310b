"""Fuzzy line dedup: one line stays of each group of lines that are equal or nearly so, over all documents.

Lines are compared with A-Z folded and white space runs as one space; a line without anything else is no line here and always stays. Each distinct line
gets a one-permutation MinHash signature of its shingles (8 characters; a shorter line is one shingle), densified where lines are short;
bands of the signatures make candidates, candidates are verified by the exact Jaccard similarity of their shingle sets, and the verified
links are joined by a distributed union-find. Of each component the first occurrence stays, by (doc_id, line number).

Within a task equal lines count once and a band's bucket is reduced to a leader before the shuffle, so a line that a third of the documents
hold costs one entry per task; its places move with the task that found them, never to the task of its hash. After the first round over all lines, only lines
that shared a band with another go on: buckets that still hold several components are compared in full: small ones at once, large ones
block by block after rounds of leaders, as in near_dedup. Lines are known by 64-bit hashes: among n distinct lines some n * n / 2**65 pairs would be
taken for equal.

Defined cases: null texts stay null, empty ones empty; blank lines stay. Documents whose rows are repeated word for word keep the same
lines in each row. A null doc_id comes last in order; ids that aren't whole numbers are an error. A document may lose all its lines: its text is
then empty. Very long texts are read whole. An empty table gives no rows. Columns n_lines and n_dropped are the operator's own and replace ones of
these names; all other columns pass through as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs as B
from . import kernel as K
from . import near_dedup as N
from .components import components
from .parity import LongParities, allowance, parities
from .shared import bounded_batches, discard, integer_ids, parts, ranges, staged, unused

_U = np.uint64
#: Shingle characters; percent of similarity; bands and rows: a pair at 75 % shares a band with probability 0.9995.
SHINGLE, SIMILAR, BANDS, ROWS = 8, 75, 20, 4
BINS = BANDS * ROWS
#: Bits of the parity sketch that travels with a candidate line; a longer one lies in a file that workers map.
PARITY = 256
#: Bits of the filter of candidate lines, as a power of two: they follow the candidates up to 32 MB, and a full filter only passes more.
FILTER_BITS = 20, 28
#: Bytes of a line, about, for the number of ranges; lines that a range holds, about.
LINE, ENTRIES = 200, 2_000_000
_EMPTY = np.uint32(0xFFFFFFFF)


def normal_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Normalised bytes; starts, ends, text index, number among the text's lines and hash of the lines that have a word."""
    none = np.zeros(0, np.int64)
    text, keep = K.lowered(data), K.not_space(data)
    starts, ends, owner = K.runs(keep, offs)
    if not len(starts):
        return text[:0], none, none, none, none, none
    breaks = np.flatnonzero(data == 10)
    line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(starts, breaks, "right"), prepend=0, append=len(starts)))
    first = np.ones(len(starts), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    gap = starts[~first] - 1  # one space before each word but a line's first
    keep[gap] = True
    text[gap] = 32
    size = ends - starts
    begin = np.cumsum(size + ~first) - size
    at = np.flatnonzero(first)
    nth = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    h = np.add.reduceat(K.mix(K.hashes(text, starts, ends) + nth.astype(_U) * K._STEP), at)
    ls, last = begin[at], np.append(at[1:], len(starts)) - 1
    number = line[at] - np.searchsorted(breaks, offs[owner[at]])
    return text[keep], ls, begin[last] + size[last], owner[at], number, K.mix(h).view(np.int64)


def _shingles(text: np.ndarray, ls: np.ndarray, le: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """For lines in order: a number for the 8 characters from each byte on, from the first line's begin to the last one's end; how many bytes from each
    line's begin on may begin a shingle; and which bytes go on a character instead of beginning one (None: none does).

    The number is the 8 bytes themselves where each character has one, and a hash of all their bytes else."""
    t = text[ls[0] : le[-1]]
    ls, le, n = ls - ls[0], le - ls[0], len(t)
    wide = np.ndarray((n + 25,), "<u8", np.concatenate([t, np.zeros(32, np.uint8)]).tobytes(), strides=(1,))
    got = wide[:n].astype(_U)
    inner = (t & np.uint8(0xC0)) == 0x80
    on = np.flatnonzero(inner)
    if not len(on):
        size = np.maximum(le - ls - SHINGLE + 1, 1)
        short = le - ls < SHINGLE
        _hashed(got, wide, ls[short], le[short])
        return got, size, None
    before = np.cumsum(inner, dtype=np.int32)  # characters that go on up to and with a byte
    begins = np.append(np.flatnonzero(~inner).astype(np.int32), np.int32(n))
    rank = ls - before[ls]
    chars = le - ls - before[le - 1] + before[ls]
    size = begins[rank + np.maximum(chars - SHINGLE, 0)] - ls + 1
    # windows with a character of several bytes: their 8 characters end where the line does at the latest, as the next byte begins one
    near = np.zeros(n + SHINGLE, bool)
    for k in range(SHINGLE):
        near[on - k] = True  # before the first byte is beyond the last one
    spans = np.stack([size, np.append(ls[1:], n) - ls - size], 1).ravel()
    odd = np.flatnonzero(near[:n] & ~inner & np.repeat(np.tile([True, False], len(ls)), spans))
    short = chars < SHINGLE
    at = begins[np.minimum(odd - before[odd] + SHINGLE, len(begins) - 1)]
    _hashed(got, wide, odd, at)
    got[ls[short]] = wide[ls[short]]
    _hashed(got, wide, ls[short], le[short])
    return got, size, inner


def _hashed(got: np.ndarray, wide: np.ndarray, at: np.ndarray, end: np.ndarray) -> None:
    """Puts in place what stands for the bytes from `at` to `end`, 32 at most."""
    if not len(at):
        return
    left = end - at
    x = wide[at] & K._KEEP[np.minimum(left, 8)]
    for step in (8, 16, 24):
        more = np.flatnonzero(left > step)
        if not len(more):
            break
        x[more] = x[more] * K._STEP ^ (wide[at[more] + step] & K._KEEP[np.minimum(left[more] - step, 8)])
    got[at] = x


def _donors(seed: int = 29) -> np.ndarray:
    r = np.random.default_rng(seed)
    return np.stack([r.permutation(BINS) for _ in range(BINS)])


def signatures(text: np.ndarray, ls: np.ndarray, le: np.ndarray) -> np.ndarray:
    """(lines, BINS) least shingle hash of each bin, for lines in order; an empty bin takes the value of the first filled one in its own
    random order."""
    n = len(ls)
    if not n:
        return np.zeros((0, BINS), np.uint32)
    h, many, inner = _shingles(text, ls, le)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0x9E3779B97F4A7C15)
    # each position's row; those too near a line's end, between lines and within a character go to a row beyond the last
    size = np.empty((n, 2), np.int64)
    size[:, 0] = many
    size[:, 1] = np.append(ls[1:], le[-1]) - ls - many
    row = np.full((n, 2), n, np.int64)
    row[:, 0] = np.arange(n)
    where = np.repeat(row.ravel() * BINS, size.ravel())
    if inner is not None:
        where[inner] = n * BINS
    where += (((h >> _U(32)) * _U(BINS)) >> _U(32)).view(np.int64)
    out = np.full((n + 1) * BINS, _EMPTY, np.uint32)
    np.minimum.at(out, where, h.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    out = out.reshape(-1, BINS)[:n].copy()
    row, bin_ = np.nonzero(out == _EMPTY)
    source, donors = out.copy(), _donors()
    for t in range(BINS):
        if not len(row):
            break
        got = source[row, donors[bin_, t]]
        done = got != _EMPTY
        out[row[done], bin_[done]] = got[done]
        row, bin_ = row[~done], bin_[~done]
    return out


def _lines(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row of a chunk, normalised bytes, starts, ends, row, line number and hash of its lines."""
    for lo, _, data, offs in K.chunks(column, 2 << 20):
        text, ls, le, owner, number, h = normal_lines(data, offs)
        yield lo, text, ls, le, owner + lo, number, h


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text, starts, ends and hashes of the lines that a task hasn't given before."""
    seen = np.zeros(0, np.int64)
    for b in batches:
        for _, text, ls, le, _, _, h in _lines(b.column("text")):
            own, at = np.unique(h, return_index=True)
            at = np.sort(at[~np.isin(own, seen)])
            seen = np.union1d(seen, own)
            yield text, ls[at], le[at], h[at]


def signed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Hash (as id and as label) and signature of each task's distinct lines, as near_dedup.candidates reads them; sketches come later."""
    none = (np.zeros((0, PARITY // 64), _U), np.zeros(0, np.int64))
    for text, ls, le, h in _distinct(batches):
        for i in range(0, len(h), 8192):
            part = slice(i, i + 8192)
            yield h[part], h[part], signatures(text, ls[part], le[part]), *none


def _filter(ids: DataFrame, power: int) -> np.ndarray:
    """2 ** power bits, one for each possible top of a hash, set where ids has one."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(1 << power, bool)
        for b in batches:
            got[(b.column("id").to_numpy().view(_U) >> _U(64 - power)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(got).tobytes()], pa.binary())], names=["bits"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(1 << (power - 3), np.uint8)
        for b in batches:
            for x in b.column("bits"):
                got |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (power - 3), np.uint8)
    for r in ids.mapInArrow(bits, "bits binary").repartition(4).mapInArrow(both, "bits binary").collect():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


#: A row of what the second pass finds. n and text are null: an occurrence. n is set: a line that comes n times, first in this place. text is set: a line's text.
#: line is twice the line's number, and 1 more where the document has no id (which then is 0).
FOUND = "id long, digest long, line long, hash long, n long, text binary"


def occurrences_and_texts(docs: DataFrame, pool: DataFrame, entries: int) -> DataFrame:
    """docs: id, digest, text. Rows for each line that occurs again or may be in the pool, for its occurrences, and for the text of each line that may
    be in the pool. A filter of the pool's hashes decides, of bounded size; it lets a few others through.

    A task counts its own lines first and sends one entry for each, with its first place, by hash range. Further places of a line that it holds more than once
    go to a range by the task, as they matter in any case: so no range gets all places of a line. A line's text moves once for each task
    that has it."""
    spark = docs.sparkSession
    n = ranges(spark, entries, ENTRIES)
    power = min(max(entries * 8, 1).bit_length(), FILTER_BITS[1])
    power = max(power, FILTER_BITS[0])
    bits = spark.sparkContext.broadcast(_filter(pool, power))

    def wanted(h: np.ndarray) -> np.ndarray:
        top = (h.view(_U) >> _U(64 - power)).astype(np.int64)
        return (bits.value[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1 == 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, held, texts = np.zeros(0, np.int64), [], [[] for _ in range(n)]
        for b in batches:
            flag = b.column("id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids, digests = b.column("id").fill_null(0).to_numpy(), b.column("digest").to_numpy()
            for _, text, ls, le, row, number, h in _lines(b.column("text")):
                if not len(h):
                    continue
                held.append((h, ids[row], digests[row], 2 * number + flag[row]))
                at = np.flatnonzero(wanted(h))
                own, k = np.unique(h[at], return_index=True)
                at = np.sort(at[k[~np.isin(own, seen)]])
                seen = np.union1d(seen, own)
                for x, k in zip(at.tolist(), B.bucket_of(h[at].view(_U), n).tolist(), strict=True):
                    texts[k].append((int(h[x]), text[ls[x] : le[x]].tobytes()))
        if held:
            h, ids, digests, number = (np.concatenate(x) for x in zip(*held, strict=True))
            del held
            order = np.lexsort((number, digests, ids, number & 1, h.view(_U)))  # the first place of each line first
            s = h[order]
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            times = np.diff(np.append(at, len(s)))
            first = order[at]
            for k, p in B.dealt(B.bucket_of(h[first].view(_U), n), n):
                f = first[p]
                yield B.rows([(k, b"o" + B.pack(h[f].view(_U), *(x[f].view(_U) for x in (ids, digests, number)), times[p].astype(_U)))])
            again = order[np.repeat(times > 1, times)]
            if len(again):
                yield B.rows([(TaskContext.get().partitionId() % n, b"p" + B.pack(h[again].view(_U), *(x[again].view(_U) for x in (ids, digests, number))))])
            for k, own in enumerate(texts):
                if own:
                    sink = pa.BufferOutputStream()
                    t = pa.table({"hash": pa.array([x for x, _ in own], pa.int64()), "text": pa.array([x for _, x in own], pa.binary())})
                    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_table(t)
                    yield B.rows([(k, b"t" + sink.getvalue().to_pybytes())])

    schema = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("line", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])

    def places(h: np.ndarray, ids: np.ndarray, digests: np.ndarray, number: np.ndarray, times: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(h), 1 << 16):
            p = slice(i, i + (1 << 16))
            none = len(h[p])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[p]) for x in (ids, digests, number, h)), pa.nulls(none, pa.int64()) if times is None else pa.array(times[p]), pa.nulls(none, pa.binary())], schema=schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [], {}
        for b in batches:
            for blob in b.column("blob"):
                raw = blob.as_py()
                if raw[:1] == b"o":
                    held.append(B.unpack(raw[1:], 5))
                elif raw[:1] == b"p":
                    yield from places(*(x.view(np.int64) for x in B.unpack(raw[1:], 4)))
                else:
                    for x in pa.ipc.open_stream(raw[1:]):
                        texts.update(zip(x.column("hash").to_pylist(), x.column("text").to_pylist(), strict=True))
        if held:
            h, ids, digests, number, times = (np.concatenate(x).view(np.int64) for x in zip(*held, strict=True))
            del held
            order = np.lexsort((number, digests, ids, number & 1, h))
            s = h[order]
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            tasks, total = np.diff(np.append(at, len(s))), np.add.reduceat(times[order], at)
            good = (total > 1) | wanted(s[at])
            f = order[at[good]]
            yield from places(h[f], ids[f], digests[f], number[f], total[good])
            alone = order[np.repeat(good, tasks)]
            alone = alone[times[alone] == 1]  # places of lines that a task holds more often have come by the task
            yield from places(h[alone], ids[alone], digests[alone], number[alone])
        keys = list(texts)
        for i in range(0, len(keys), 4096):
            part = keys[i : i + 4096]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(part, pa.int64()), none, pa.array([texts[x] for x in part], pa.binary())], schema=schema)

    return docs.select("id", "digest", "text").mapInArrow(read, B.BLOB_ROWS).repartitionById(n, F.col("bucket")).mapInArrow(gather, FOUND)


def sketched(found: DataFrame, pool: DataFrame) -> DataFrame:
    """id, text (normalised bytes), signature and short parity of the pool's lines."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x.as_buffer()) for x in b.column("text")], np.int64)
            text = np.frombuffer(b"".join(b.column("text").to_pylist()), np.uint8)
            end = np.cumsum(size)
            s = signatures(text, end - size, end)
            bits, n = parities(_sets(b.column("text")), PARITY)
            columns = [b.column("id"), b.column("text"), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "sig", "parity", "n"])

    lines = found.where("text is not null").select(F.col("hash").alias("id"), "text").join(pool, "id")
    return lines.select("id", "text").mapInArrow(sign, "id long, text binary, sig binary, parity binary, n long")


def parity_sketches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Sets with a Jaccard similarity of s differ in (1 - s) / (1 + s) of the sum of their sizes: the bits in which parities may differ. No pair that
    reaches the similarity is left out."""
    bits = np.frombuffer(b"".join(batch.column("parity").to_pylist()), _U).reshape(batch.num_rows, PARITY // 64)
    return bits, allowance(batch.column("n").to_numpy(), SIMILAR)


def _set(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(values)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The shingle set of each line."""
    texts = column.to_pylist()
    if not texts:
        return []
    le = np.cumsum([len(x) for x in texts])
    ls = np.append(0, le[:-1])
    all_, many, inner = _shingles(np.frombuffer(b"".join(texts), np.uint8), ls, le)
    out = []
    for a, n in zip(ls.tolist(), many.tolist(), strict=True):
        own = all_[a : a + n]
        out.append(_set(own if inner is None else own[~inner[a : a + n]]))
    return out


def verified(pairs: DataFrame, lines: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Pairs whose exact Jaccard similarity of shingles reaches `similar` percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                good = np.zeros(b.num_rows, bool)
                for i, (p, q) in enumerate(zip(_sets(b.column("ta")), _sets(b.column("tb")), strict=True)):
                    both = np.count_nonzero(p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q)
                    good[i] = 100 * both >= similar * (len(p) + len(q) - both)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good))

    left = lines.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = lines.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def line_components(docs: DataFrame, rounds: int = N.ROUNDS) -> tuple[DataFrame, DataFrame]:
    """docs: id, digest, text. Line hashes with the component of those that have a near copy, and what occurrences_and_texts found."""
    spark = docs.sparkSession
    shape = {"bands": BANDS, "rows": ROWS, "sketches": parity_sketches, "words": PARITY // 64}
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape["n"] = ranges(spark, BANDS * (size // LINE), N.ENTRIES)
    pairs = staged(N.candidates(docs.select("text"), 0, **shape, read=signed_lines), "line_pairs")
    pool = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "line_pool")
    found = staged(occurrences_and_texts(docs, pool, size // LINE), "occurrences")
    lines = staged(sketched(found, pool), "line_texts")
    links = labels = large = None
    found_links, last = 0, False
    for round_ in count():
        if round_ == 2:
            shape["refine"] = LongParities(lines, _sets, SIMILAR, lines.count()).refine
        last = round_ > 2 and (not found_links or round_ >= rounds)
        if round_:
            discard(docs.sparkSession, pairs)
            named = lines.join(labels, "id", "left").select("id", "sig", "parity", "n", F.coalesce("component", "id").alias("label"))
            pairs = staged(N.across(named, large, **shape) if last else N.candidates(named, round_, **shape, only=large), "line_pairs")
        if round_ == 2:
            large = N.large_keys(pairs)
            last = not len(large)
        found_links = 0
        if round_ < 2 or not pairs.where("a is not null").isEmpty():
            new = staged(verified(pairs, lines), "line_links")
            found_links = new.count()
            links = new if links is None else links.union(new)
        if found_links or labels is None:
            labels = components(links)
        if last:
            break
    discard(docs.sparkSession, pool, lines)
    return labels, found


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of the text, and n_lines and n_dropped; same rows, other columns as they are."""
    bounded_batches(docs.sparkSession)
    integer_ids(docs, id_column)
    text, own = F.col(f"`{text_column}`").cast("string"), F.col(f"`{id_column}`").cast("long")
    keyed = docs.select(own.alias("id"), F.xxhash64(text).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
    labels, found = line_components(keyed)
    place = F.struct(F.col("line").bitwiseAND(F.lit(1).cast("long")).alias("none"), "id", "digest", "line")
    by_line = found.where("n is not null").select("hash", place.alias("first"), "n")
    named = labels.union(labels.select("component", "component").distinct()).select(F.col("id").alias("hash"), "component")
    by_line = staged(by_line.join(named, "hash", "left").where("n > 1 or component is not null"), "repeated_lines")
    groups = by_line.select("hash", F.coalesce("component", "hash").alias("component"), "first")
    best = staged(groups.groupBy("component").agg(F.min("first").alias("keep")), "component_lines")  # as a plain scan: the skew join can split a large component
    keep = staged(groups.join(best, "component").select("hash", "keep"), "kept_lines")
    gone = found.where("n is null and text is null").join(keep, "hash").where(place != F.col("keep"))
    i, d, none, lines = unused(docs, "_i", "_d", "_none", "_lines")
    gone = gone.groupBy(F.col("id").alias(i), F.col("digest").alias(d), (F.col("line").bitwiseAND(F.lit(1).cast("long")) == 1).alias(none))
    gone = staged(gone.agg(F.collect_set(F.shiftright("line", 1)).alias(lines)), "dropped_lines")
    both = docs.join(gone.hint("shuffle_hash"), (F.coalesce(own, F.lit(0).cast("long")) == F.col(i)) & (F.xxhash64(text) == F.col(d)) & (own.isNull() == F.col(none)), "left")
    left = F.when(F.col(lines).isNull(), text).otherwise(F.arrow_udf(_without, T.StringType())(F.when(F.col(lines).isNotNull(), text), F.col(lines)))  # other texts stay in the JVM
    n_lines = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    kept = [(left.cast(docs.schema[c].dataType).alias(c) if c == text_column else F.col(f"`{c}`")) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return both.select(*kept, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(F.col(lines)), F.lit(0)).cast("long").alias("n_dropped"))


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines of these numbers."""
    out = []
    for text, numbers in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        if text is not None:
            away = set(numbers)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
        out.append(text)
    return pa.array(out, pa.string())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: doc_id, the text that stays, lines before and lines dropped."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
