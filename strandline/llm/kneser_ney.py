"""Interpolated modified Kneser-Ney model of any order, counted in Spark and memory-mapped by the workers.

    P(w | c) = (max(a(c,w) - D(a(c,w)), 0) + (D1 N1(c) + D2 N2(c) + D3 N3+(c)) P(w | c')) / a(c)
    Q(w)     = (max(t(w) - E(t(w)), 0) + (E1 m1 + E2 m2 + E3 m3+) / (V + 1)) / T

c' is the context c without its first word; Q stands for P without a context. In the highest order a(c,w) is how often c,w comes in the training tokens, in
lower ones how many words it follows there; a context of text begins has nothing before it, so there it is the count again. a(c) is the
sum over w; Ni(c) is how many words follow c with a = i; t(w) is how many words w follows; T is the sum of t; mi is how many words have
t = i; D (for each order) and E are the discounts that the counts of counts give. Q leaves a share for words never seen, so the
probabilities over the V known words and one unknown add up to 1. A context never seen gives what the shorter one gives.

(1) Words: each task sums its word hashes and sends one packed blob to each range of hashes; each range becomes a file of sorted hashes and counts.
Words are numbered by classes of counts, frequent ones first, so that most numbers are small and cost few bytes. (2) Sequences of the highest order: the same with word numbers, dealt by a hash of the whole sequence, so those of a
frequent word or pair spread over all ranges; each range writes its file and sends on what it knows of contexts and continuations, which are the
sequences of the next lower order, down to the words. (3) Scoring: workers map the files that they need and look sorted keys up by
binary search; of sequences half a hash is kept, the other half is their place. What is shuffled and stored follows the distinct sequences of the input; their ranges follow its size. Files begin with their own sums,
and the driver sees the sums of those, and the sizes of the word files by class, of which there are as many as shuffle partitions.

Defined cases: a null text is empty; an empty text is its end token alone. Without any training text N, V and n_known are 0 and both
scores are 0 for every token. Repeated rows count again and are scored again; ids may be null. Very long texts are read whole. Up to 2**32 - 3
distinct words; beyond that the fit raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs as B
from . import kernel as K
from .shared import bounded_batches, fold, fresh, parts, text_or_empty

_U = np.uint64
#: Hash of the end token; numbers of the begin context and of words never seen.
END = _U(0x5E2D58D8B3BCDF1A)
BEGIN, UNKNOWN = (1 << 32) - 1, (1 << 32) - 2
#: Entries that a task gathers before it sends them on; training tokens for each range of sequences, about.
HELD, TOKENS = 1_000_000, 3_000_000
#: Words of the longest sequences.
ORDER = 3
#: Classes of counts by which words are numbered; each but the last spans a factor of four.
CLASSES = 16


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text, each followed by END, and the n + 1 offsets."""
    data = K.lowered(data)
    starts, ends, owner = K.words(data, offs)
    n = np.bincount(owner, minlength=len(offs) - 1) + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.full(bounds[-1], END, _U)
    out[np.arange(len(starts)) + owner] = K.hashes(data, starts, ends)
    return out, bounds


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for _, _, data, offs in K.chunks(b.column("text"), 2 << 20):
            yield tokens(data, offs)


def _summed(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the columns in order, and each value summed by row."""
    if not len(columns[0]):
        return columns, values
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], [np.add.reduceat(v[order], at) for v in values]


def _sent(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Sorted rows in few bytes: of the first column the steps of the upper halves, and those of the lower halves within an upper one."""
    first = columns[0]
    up, down = first >> _U(32), first & _U(0xFFFFFFFF)
    step, inner = up.copy(), down.copy()
    step[1:] -= up[:-1]
    same = np.flatnonzero(step[1:] == 0) + 1
    inner[same] -= down[same - 1]
    return B.squeezed(step << _U(32) | inner, *columns[1:], *values)


def _received(blob: bytes, columns: int) -> list[np.ndarray]:
    """The columns and values of _sent."""
    out = B.restored(blob, columns)
    if n := len(out[0]):
        step, inner = out[0] >> _U(32), out[0] & _U(0xFFFFFFFF)
        new = step > 0
        new[0] = True
        at, sums = np.flatnonzero(new), np.cumsum(inner, dtype=_U)
        before = np.repeat(sums[at] - inner[at], np.diff(np.append(at, n)))
        out[0] = np.cumsum(step, dtype=_U) << _U(32) | (sums - before)
    return out


class _Gather:
    """Counts of rows within a task, packed by bucket when they get many."""

    def __init__(self, bucket, buckets: int):
        self.bucket, self.buckets, self.held, self.n = bucket, buckets, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns, count = _summed(list(columns), [np.ones(len(columns[0]), _U)])
        self.held.append([*columns, *count])
        self.n += len(columns[0])
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            *columns, count = (np.concatenate(x) for x in zip(*self.held, strict=True))
            columns, (count,) = _summed(columns, [count])
            self.held, self.n = [], 0
            for b, at in B.dealt(self.bucket(*columns), self.buckets):
                yield B.rows([(b, _sent([c[at] for c in columns], [count[at]]))])


def _merged(batches: Iterator[pa.RecordBatch], keys: int, values: int) -> tuple[int | None, list[np.ndarray], list[np.ndarray]]:
    """The one bucket of a partition and the sums of all its blobs; summed whenever they have doubled."""
    bucket, held, n, last = None, [], 0, 0

    def both() -> tuple[list[np.ndarray], list[np.ndarray]]:
        every = [np.concatenate(x) for x in zip(*held, strict=True)]
        return _summed(every[:keys], every[keys:])

    for b in batches:
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob"), strict=True):
            bucket = k
            held.append(_received(blob.as_py(), keys + values))
            n += len(held[-1][0])
            if n > max(HELD, 2 * last):
                columns, sums = both()
                held = [[*columns, *sums]]
                n = last = len(columns[0])
    if not held:
        return bucket, [np.zeros(0, _U)] * keys, [np.zeros(0, _U)] * values
    return bucket, *both()


def _packed(words: list[np.ndarray]) -> list[np.ndarray]:
    """Word numbers of sequences, two in a column."""
    return [words[i] << _U(32) | words[i + 1] if i + 1 < len(words) else words[i] for i in range(0, len(words), 2)]


def _unpacked(columns: list[np.ndarray], length: int) -> list[np.ndarray]:
    out = []
    for i, c in enumerate(columns):
        out += [c >> _U(32), c & _U(0xFFFFFFFF)] if 2 * i + 1 < length else [c]
    return out


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = K.mix(columns[0])
    for c in columns[1:]:
        h = K.mix(h * K._STEP + c)
    return h


#: Numbers at the head of a file of sequences: how many; those with own counts 1, 2, 3 and 4; sums for the context of text begins; all with own counts;
#: then slots, the first top half of a hash and their width; and last how many large values each column has.
HEAD, SLOT, LARGE = 20, 16, 15


def _slots(h: np.ndarray, slots: int, low: int, width: int) -> np.ndarray:
    """Slots of hashes by their top halves, rising with them."""
    return (((h >> _U(32)) - _U(low)) * _U(slots) // _U(width)).astype(np.int64)


def _write(uri: str, h: np.ndarray, values: list[np.ndarray], head: list[int]) -> None:
    """Hash array and half a byte for each value; values of LARGE and more follow. Hashes lie in slots of about SLOT each by their top halves, and only their other
    halves are kept, sorted within a slot: a sequence that isn't there is taken for one that is once in SLOT / 2**32."""
    n = len(h)
    slots, low = max(1, n // SLOT), int(h.min() >> _U(32))
    width = int(h.max() >> _U(32)) - low + 1
    slot = _slots(h, slots, low, width)
    order = np.lexsort((h.astype(np.uint32), slot))
    small, rest, many = [], [], []
    for v in values:
        v = v[order].astype(np.int64)
        large = np.flatnonzero(v >= LARGE)
        halves = np.zeros(n + n % 2, np.uint8)
        halves[:n] = np.minimum(v, LARGE)
        small.append(halves[::2] | halves[1::2] << 4)
        rest += [large, v[large]]
        many.append(len(large))
    numbers = np.zeros(HEAD, np.int64)
    numbers[: 1 + len(head)] = [n, *head]
    numbers[10:13] = slots, low, width
    numbers[HEAD - len(many) :] = many
    starts = np.searchsorted(slot[order], np.arange(slots + 1)).astype(np.uint32)
    pad = np.zeros(-(4 * (slots + 1 + n) + len(values) * len(small[0])) % 8, np.uint8)
    B.put(uri, numbers, starts, h[order].astype(np.uint32), *small, pad, *rest)


def _head(uri: str) -> np.ndarray:
    try:
        return np.frombuffer(B.mapped(uri), np.int64, HEAD)
    except FileNotFoundError:  # a range without sequences has no file
        return np.zeros(HEAD, np.int64)


def _found(uri: str, h: np.ndarray, columns: int) -> np.ndarray:
    """(columns, keys) values of hashes; 0 where there is none."""
    out, head = np.zeros((columns, len(h)), np.int64), _head(uri)
    n, slots, low, width = (int(head[i]) for i in (0, 10, 11, 12))
    if not n:
        return out
    raw = B.mapped(uri)
    starts, known = np.frombuffer(raw, np.uint32, slots + 1, 8 * HEAD), np.frombuffer(raw, np.uint32, n, 8 * HEAD + 4 * (slots + 1))
    asked = np.flatnonzero(((h >> _U(32)) >= _U(low)) & ((h >> _U(32)) < _U(low + width)))
    slot, half = _slots(h[asked], slots, low, width), h[asked].astype(np.uint32)
    lo, hi = starts[slot].astype(np.int64), starts[slot + 1].astype(np.int64)
    end = hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:  # a binary search in each slot
        middle = (lo[open_] + hi[open_]) >> 1
        less = known[middle] < half[open_]
        lo[open_[less]] = middle[less] + 1
        hi[open_[~less]] = middle[~less]
    hit = np.flatnonzero((lo < end) & (known[np.minimum(lo, n - 1)] == half))
    at, hit = lo[hit], asked[hit]
    begin = 8 * HEAD + 4 * (slots + 1 + n)
    half_n = (n + 1) // 2
    rest = begin + columns * half_n
    rest += -rest % 8
    for c, many in enumerate(head[HEAD - columns :].tolist()):
        v = (np.frombuffer(raw, np.uint8, half_n, begin + c * half_n)[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & LARGE).astype(np.int64)
        if (large := np.flatnonzero(v == LARGE)).size:
            where, values = np.frombuffer(raw, np.int64, many, rest), np.frombuffer(raw, np.int64, many, rest + 8 * many)
            v[large] = values[np.searchsorted(where, at[large])]
        out[c, hit] = v
        rest += 16 * many
    return out


def _classes(count: np.ndarray) -> np.ndarray:
    """Classes of counts, those of the most frequent words first."""
    return CLASSES - 1 - np.minimum(np.frexp(count.astype(float))[1] // 2, CLASSES - 1)


class Words:
    """The word files: number, count and statistics by hash. sizes: words of each range (rows) and class (columns). Numbers go by class, then by range, then by
    hash; within its range a word's place goes by class and hash, and a file holds places by hash, and counts and statistics by place."""

    def __init__(self, root: str, sizes: np.ndarray):
        self.root, self.sizes = root, sizes.sum(axis=1)
        self.first = np.concatenate([[0], np.cumsum(sizes.T.ravel())])
        self.start = np.cumsum(sizes, axis=1) - sizes  # place of the first word of each range and class

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes; UNKNOWN where there is none."""
        out, ranges = np.full(len(h), UNKNOWN, _U), len(self.sizes)
        where = B.bucket_of(h, ranges)
        bounds = np.searchsorted(where, np.arange(ranges + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            if n := int(self.sizes[k]):
                raw = B.mapped(f"{self.root}/words-{k}")
                known, places = np.frombuffer(raw, _U, n), np.frombuffer(raw, np.uint32, n, 16 * n)
                part = h[bounds[k] : bounds[k + 1]]
                at = np.searchsorted(known, part)
                hit = known[np.minimum(at, n - 1)] == part
                place = places[at[hit]].astype(np.int64)
                kind = np.searchsorted(self.start[k], place, "right") - 1
                out[bounds[k] : bounds[k + 1]][hit] = (self.first[kind * ranges + k] + place - self.start[k][kind]).astype(_U)
        return out

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of known numbers, and places in them."""
        ids = ids.astype(np.int64)
        run = np.searchsorted(self.first, ids, "right") - 1
        kind, k = np.divmod(run, len(self.sizes))
        return k, ids - self.first[run] + self.start[k, kind]

    def columns(self, ids: np.ndarray) -> np.ndarray:
        """Rows count, n(c), N1, N2, N3+, t of known numbers."""
        out = np.zeros((6, len(ids)), np.int64)
        where, place = self.places(ids)
        for k, part in B.dealt(where, len(self.sizes)):
            n, at = int(self.sizes[k]), place[part]
            out[0, part] = np.frombuffer(B.mapped(f"{self.root}/words-{k}"), np.int64, n, 8 * n)[at]
            stats = B.mapped(f"{self.root}/stats-{k}")
            out[1, part] = np.frombuffer(stats, np.int64, n)[at]
            for c in range(4):
                out[2 + c, part] = np.frombuffer(stats, np.uint32, n, 8 * n + 4 * n * c)[at]
        return out


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 1, 2 and 3 or more, from how many have count 1, 2, 3 and 4. Where a count of counts is 0, 0.5, 1 and 1.5."""
    if min(n[:4]) <= 0:
        return np.array([0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.clip(d, [0.01, 0.02, 0.03], [0.99, 1.98, 2.97])


class Model:
    """A fitted model: paths of its files and a few numbers. counts: of counts 1 to 4, by order; continued: of t, and of t beyond 2."""

    def __init__(self, words: Words, order: int, ranges: int, begin: np.ndarray, counts: dict[int, np.ndarray], continued: np.ndarray, types: float):
        self.words, self.order, self.ranges, self.begin = words, order, ranges, begin
        self.n_words, self.n_tokens = int(words.first[-1]), 0
        self.d, self.e = {k: discounts(c) for k, c in counts.items()}, discounts(continued[:4])
        self.types = types
        rest = continued[[0, 1]].tolist() + [continued[4]]
        self.spread = float(np.dot(self.e, rest)) / (self.n_words + 1)

    def values(self, length: int, words: list[np.ndarray], columns: int) -> np.ndarray:
        """(columns, keys) values of sequences of a length."""
        h, back = np.unique(_hash(_packed(words)), return_inverse=True)
        out = np.zeros((columns, len(h)), np.int64)
        where = B.bucket_of(h, self.ranges)
        bounds = np.searchsorted(where, np.arange(self.ranges + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[k], bounds[k + 1])
            out[:, part] = _found(f"{self.words.root}/grams-{length}-{k}", h[part], columns)
        return out[:, back]

    def score(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_known, base score and log10 probability of each text."""
        n_texts = len(bounds) - 1
        owner = np.repeat(np.arange(n_texts), np.diff(bounds))
        distinct, back = np.unique(h, return_inverse=True)
        word = self.words.numbers(distinct)
        known = word != UNKNOWN
        stats = np.zeros((6, len(distinct)), np.int64)
        stats[:, known] = self.words.columns(word[known])
        count, t = stats[0], stats[5]
        base = np.log10((count + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))
        lower = (np.maximum(t - self.e[np.clip(t, 1, 3) - 1], 0) * (t > 0) + self.spread) / max(1.0, self.types)
        p = lower[back]
        before = _before(word[back], bounds, self.order)
        context = np.roll(back, 1)
        c = stats[1:5][:, context]
        c[:, bounds[:-1]] = self.begin[:, None]
        for k in range(2, self.order + 1):
            found = self.values(k, before[-k:], 1 if k == self.order else 5)
            own, d = found[0], self.d[k]
            taken = np.maximum(own - d[np.clip(own, 1, 3) - 1], 0) * (own > 0)
            p = np.where(c[0] > 0, (taken + (d @ c[1:]) * p) / np.maximum(c[0], 1), p)
            if k < self.order:  # the context of a token is the sequence that ends before it
                c = np.roll(found[1:], 1, axis=1)
                c[:, bounds[:-1]] = self.values(k, [np.array([BEGIN], _U)] * k, 5)[1:]
        return (np.bincount(owner, count[back] > 0, n_texts).astype(np.int64), np.bincount(owner, base[back], n_texts), np.bincount(owner, np.log10(p), n_texts))


def _before(ids: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """Of each token the numbers of the order - 1 before it, farthest first, and its own; BEGIN where the text hasn't begun."""
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = []
    for k in range(order - 1, 0, -1):
        moved = np.roll(ids, k)
        moved[place < k] = BEGIN
        out.append(moved)
    return [*out, ids]


def fit(texts: DataFrame, order: int = ORDER) -> Model:
    """texts: the column `text`, without nulls. order: words of the longest sequences, 2 or more."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = texts.sparkSession
    root = fresh(spark, "kneser_ney")
    bounded_batches(spark)
    n = parts(spark)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Gather(lambda h: B.bucket_of(h, n), n)
        for h, _ in _texts(batches):
            yield from g.add(h)
        yield from g.flush()

    def word_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, (h,), (count,) = _merged(batches, 1, 1)
        if bucket is not None:
            kind = _classes(count)
            order = np.argsort(kind, kind="stable")
            place = np.empty(len(h), np.uint32)
            place[order] = np.arange(len(h), dtype=np.uint32)
            B.put(f"{root}/words-{bucket}", h, count[order], place)
            sizes = np.bincount(kind, minlength=CLASSES).tolist()
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "sizes": sizes, "total": int(count.sum())}], pa.schema([("bucket", pa.int32()), ("sizes", pa.list_(pa.int64())), ("total", pa.int64())]))

    found = texts.mapInArrow(words, B.BLOB_ROWS).repartitionById(n, F.col("bucket")).mapInArrow(word_file, "bucket int, sizes array<long>, total long").collect()
    sizes = np.zeros((n, CLASSES), np.int64)
    for r in found:
        sizes[r["bucket"]] = r["sizes"]
    known = Words(root, sizes)
    if known.first[-1] >= UNKNOWN:
        raise ValueError("more distinct words than word numbers")
    total = sum(r["total"] for r in found)
    m = max(n, -(-total // TOKENS))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Gather(lambda *c: B.bucket_of(_hash(list(c)), m), m)
        for h, bounds in _texts(batches):
            distinct, back = np.unique(h, return_inverse=True)
            yield from g.add(*_packed(_before(known.numbers(distinct)[back], bounds, order)))
        yield from g.flush()

    def level(length: int):
        """Writes a range of sequences of a length and passes on what it knows of shorter ones: as contexts, and as continuations."""
        columns, top = -(-length // 2), length == order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, keys, values = _merged(batches, columns, 1 if top else 5)
            if bucket is None:
                return
            own = values[0]
            seen = np.flatnonzero(own > 0)  # others are contexts only
            grams, c = [w[seen] for w in _unpacked(keys, length)], own[seen]
            by = [c, (c == 1).astype(_U), (c == 2).astype(_U), (c > 2).astype(_U)]
            start = grams[0] == BEGIN
            begin = [int(v[start].sum()) for v in by] if length == 2 else [0] * 4
            _write(f"{root}/grams-{length}-{bucket}", _hash(keys), values, [*(int((c == i).sum()) for i in (1, 2, 3, 4)), *begin, len(c)])
            del keys, values
            none = np.zeros(len(c), _U)
            follows = np.where(grams[1] == BEGIN, c, _U(1)) if length > 2 else none + _U(1)
            inner = np.flatnonzero(~start) if length == 2 else np.arange(len(c))
            heads, tails = _packed([g[inner] for g in grams[:-1]]), _packed(grams[1:])
            both, sums = _summed([np.concatenate(x) for x in zip(heads, tails, strict=True)], [np.concatenate([a, b]) for a, b in zip((none[inner], *(v[inner] for v in by)), (follows, none, none, none, none), strict=True)])
            where = known.places(both[0])[0] if length == 2 else B.bucket_of(_hash(both), m)
            for b, at in B.dealt(where, n if length == 2 else m):
                yield B.rows([(b, _sent([x[at] for x in both], [x[at] for x in sums]))])

        return run

    def stats_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, (ids,), values = _merged(batches, 1, 5)
        if bucket is None:
            return
        place = known.places(ids)[1]
        dense = np.zeros((5, int(known.sizes[bucket])), np.int64)
        for row, v in zip(dense, values, strict=True):
            row[place] = v.astype(np.int64)
        t = dense[0]
        B.put(f"{root}/stats-{bucket}", dense[1], *(x.astype(np.uint32) for x in (*dense[2:], t)))
        yield B.rows([(bucket, np.array([*(int((t == i).sum()) for i in (1, 2, 3, 4)), int((t > 2).sum())], np.int64).tobytes())])

    dealt = texts.mapInArrow(sequences, B.BLOB_ROWS)
    for length in range(order, 1, -1):
        dealt = dealt.repartitionById(m, F.col("bucket")).mapInArrow(level(length), B.BLOB_ROWS)
    continued = np.zeros(5)
    for r in dealt.repartitionById(n, F.col("bucket")).mapInArrow(stats_file, B.BLOB_ROWS).collect():
        continued += np.frombuffer(r["blob"], np.int64)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length in range(2, order + 1):
                total = sum((_head(f"{root}/grams-{length}-{k}") for k in b.column("id").to_pylist()), np.zeros(HEAD, np.int64))
                yield pa.RecordBatch.from_pylist([{"length": length, **{f"v{i}": int(v) for i, v in enumerate(total[1:10])}}], pa.schema([("length", pa.int32()), *((f"v{i}", pa.int64()) for i in range(9))]))

    sums = spark.range(0, m, 1, min(n, m)).mapInArrow(heads, "length int, " + ", ".join(f"v{i} long" for i in range(9))).groupBy("length").agg(*[F.sum(f"v{i}") for i in range(9)]).collect()
    by_length = {r[0]: np.array(r[1:], float) for r in sums}
    model = Model(known, order, m, by_length[2][4:8].astype(np.int64), {k: v[:4] for k, v in by_length.items()}, continued, float(by_length[2][8]))
    model.n_tokens = total
    return model


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """texts: doc_id and text. Adds n_tokens, n_known, base_score and score, in place of the text."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, got = [np.zeros(0, np.int64)], [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
            for _, _, data, offs in K.chunks(b.column("text"), 2 << 20):
                h, bounds = tokens(data, offs)
                n.append(np.diff(bounds))
                got.append(model.score(h, bounds) if model.n_tokens else (n[-1] * 0, n[-1] * 0.0, n[-1] * 0.0))
            columns = [np.concatenate(x) for x in (n, *zip(*got, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model of those outside fold 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    model = fit(docs.where(fold() != 1).select("text"))
    out = scored(docs, model)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
