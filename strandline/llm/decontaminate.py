"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and bytes beyond ASCII, A-Z folded, so punctuation doesn't hide a passage. The longest matches of a document and an item
that no earlier tile touches are marked again and again, found by running Karp-Rabin hashes, down to TILE words. Tiles may come in any
order, so reordered passages count. An item whose tiles cover at least COVER of its words contaminates the document.

Every tile is made of seeds, TILE words in a row that both have. So the words of an item that lie in shared seeds bound what tiles can cover: only pairs that
reach the threshold so are tiled, and none is lost. The benchmark is a set of queries that every document is held against where it lies: it is cut into
blocks of about LIMIT bytes, prepared once as sorted seed arrays in files that workers map. Nothing of it passes the driver, and neither texts nor
links are shuffled, however large it is.

Defined cases: null and empty texts are clean; an item of fewer than LEAST words is no evidence, as clean text has it by chance, and never matches;
repeated documents or items give repeated matches, whatever their ids, which may be null or of any type; items that share an id are items of their own.
Empty tables give no rows. Very long documents are read whole. Other columns are ignored, or kept as they are by clean().
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs as B
from . import kernel as K
from .shared import bounded_batches, fresh, staged, text_or_empty

LEAST, TILE, COVER = 5, 3, 0.6
#: Bytes of benchmark text in a block, about.
LIMIT = 16 << 20
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def _windows(words: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, running hash) of each window of `size` free words."""
    drop, h, run = pow(_BASE, size, _PRIME), 0, 0
    for i, w in enumerate(words):
        if not free[i]:
            h = run = 0
            continue
        h, run = (h * _BASE + w) % _PRIME, run + 1
        if run > size:
            h = (h - words[i - size] * drop) % _PRIME
        if run >= size:
            yield i - size + 1, h


def tiles(item: list[int], doc: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in item, start in doc, length), longest first, none touching another. Negative words match nothing."""
    free_i, free_d = [w >= 0 for w in item], [w >= 0 for w in doc]
    found: list[tuple[int, int, int]] = []
    size = least
    while size * 2 <= len(item):
        size *= 2
    while True:
        at = defaultdict(list)
        for i, h in _windows(item, free_i, size):
            at[h].append(i)
        matches = []
        for j, h in _windows(doc, free_d, size) if at else ():
            for i in at.get(h, ()):
                if i and j and free_i[i - 1] and free_d[j - 1] and item[i - 1] == doc[j - 1]:
                    continue  # part of a longer match that begins before
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n >= size:
                    matches.append((-n, i, j))
        marked = False
        for n, i, j in sorted(matches):
            if all(free_i[i : i - n]) and all(free_d[j : j - n]):
                free_i[i : i - n] = free_d[j : j - n] = [False] * -n
                found.append((i, j, -n))
                marked = True
        if not marked:
            if size == least:
                return found
            size = max(least, size // 2)


class Items:
    """A block of the benchmark: the words of its items, end to end, and its seeds in order with their places."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, places: np.ndarray, tile: int = TILE, cover: float = COVER):
        self.all, self.bounds, self.seeds, self.places, self.tile, self.cover = words, bounds, seeds, places, tile, cover

    @classmethod
    def of(cls, texts: pa.Array, tile: int = TILE, cover: float = COVER) -> Items:
        words, size = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for lo, hi, data, offs in K.chunks(texts):
            h, whose = doc_words(data, offs)
            words.append(h)
            size.append(np.bincount(whose, minlength=hi - lo))
        words, bounds = np.concatenate(words), np.cumsum(np.concatenate(size))
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        seeds, places = K.runs_of(words, owner, tile)
        good = np.diff(bounds)[owner[places]] >= LEAST
        seeds, places = seeds[good], places[good]
        order = np.argsort(seeds, kind="stable")
        return cls(words, bounds, seeds[order], places[order], tile, cover)

    def write(self, uri: str) -> None:
        B.put(uri, np.array([len(self.all), len(self.bounds), len(self.seeds)]), self.all, self.bounds.astype(np.int64), self.seeds, self.places.astype(np.int64))

    @classmethod
    def read(cls, uri: str) -> Items:
        raw = B.mapped(uri)
        w, b, s = np.frombuffer(raw, np.int64, 3).tolist()
        at = np.cumsum([24, 8 * w, 8 * b, 8 * s]).tolist()
        return cls(np.frombuffer(raw, np.uint64, w, at[0]), np.frombuffer(raw, np.int64, b, at[1]), np.frombuffer(raw, np.uint64, s, at[2]), np.frombuffer(raw, np.int64, s, at[3]))

    def judge(self, i: int, doc: np.ndarray) -> tuple[float, int]:
        """Share of item i's words that tiles in doc cover, and the number of tiles."""
        item = self.all[self.bounds[i] : self.bounds[i + 1]]
        vocabulary = {int(w): k for k, w in enumerate(dict.fromkeys(item.tolist()))}
        known = np.isin(doc, item)
        # words that the item lacks can't be in a tile: stretches of them shrink to one barrier
        keep = known.copy()
        keep[1:] |= known[:-1]
        short = [vocabulary[w] if k else -1 for w, k in zip(doc[keep].tolist(), known[keep].tolist(), strict=True)]
        got = tiles([vocabulary[w] for w in item.tolist()], short, self.tile)
        return sum(n for *_, n in got) / len(item), len(got)

    def near(self, h: np.ndarray, whose: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) wherever shared seeds hold as many of the item's words as tiles have to cover."""
        got, at = K.runs_of(h, whose, self.tile)
        if not len(got) or not len(self.seeds):
            return []
        first = np.searchsorted(self.seeds, got)
        hit = self.seeds[np.minimum(first, len(self.seeds) - 1)] == got
        once = np.unique(np.stack([whose[at[hit]], first[hit]], 1), axis=0)  # a seed that comes again covers no more
        times = np.searchsorted(self.seeds, self.seeds[once[:, 1]], "right") - once[:, 1]
        row = np.repeat(once[:, 0], times)
        place = self.places[np.repeat(once[:, 1], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        n = len(self.all)
        held = np.unique(np.concatenate([row * n + place + k for k in range(self.tile)]))
        item = np.searchsorted(self.bounds, held % n, "right") - 1
        pair, words = np.unique((held // n) * len(self.bounds) + item, return_counts=True)
        row, item = pair // len(self.bounds), pair % len(self.bounds)
        good = words >= self.cover * np.diff(self.bounds)[item]
        return list(zip(row[good].tolist(), item[good].tolist(), strict=True))

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, coverage, tiles) where coverage reaches the threshold."""
        for lo, _, data, offs in K.chunks(texts):
            h, whose = doc_words(data, offs)
            for row, i in self.near(h, whose):
                share, n = self.judge(i, h[np.searchsorted(whose, row) : np.searchsorted(whose, row, "right")])
                if share >= self.cover:
                    yield lo + row, i, share, n


def doc_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = K.lowered(data)
    starts, ends, owner = K.plain_words(data, offs)
    return K.hashes(data, starts, ends), owner


def prepared(benchmark: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, list[str]]:
    """Block, number in it and item_id of each item, and the paths of the blocks."""
    spark = benchmark.sparkSession
    bounded_batches(spark)
    root = fresh(spark, "benchmark")
    rows = benchmark.select("item_id", text_or_empty().alias("text"))
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // limit))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            block, both = TaskContext.get().partitionId(), pa.Table.from_batches(held)
            Items.of(both.column("text").cast(pa.large_string()).combine_chunks()).write(f"{root}/{block}")
            n = both.num_rows
            ids = both.column("item_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n)), ids], names=["block", "i", "item_id"])

    dealt = rows.repartition(blocks) if blocks > 1 else rows.coalesce(1)
    items = staged(dealt.mapInArrow(write, f"block int, i long, item_id {dict(benchmark.dtypes)['item_id']}"), "items")
    return items, [f"{root}/{r['block']}" for r in items.select("block").distinct().collect()]


def matches(docs: DataFrame, benchmark: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles of each contaminating pair."""
    items, paths = prepared(benchmark, limit)
    kind = dict(docs.dtypes)["doc_id"]

    def held_against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in paths:
                got = list(Items.read(path).matches(b.column("text")))
                if got:
                    row, i, share, n = zip(*got, strict=True)
                    block = np.full(len(got), int(path.rpartition("/")[2]), np.int32)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(block), pa.array(i, pa.int64()), pa.array(share, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "block", "i", "coverage", "n_tiles"])

    found = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(held_against, f"doc_id {kind}, block int, i long, coverage double, n_tiles long")
    return found.join(items, ["block", "i"]).select("doc_id", "item_id", "coverage", "n_tiles")


def clean(docs: DataFrame, benchmark: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs without the contaminated rows, all columns as they are: each row is judged where it lies, by its own text."""
    _, paths = prepared(benchmark, limit)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.ones(b.num_rows, bool)
            for path in paths:
                good[[r for r, *_ in Items.read(path).matches(b.column(b.schema.get_field_index("text")).cast(pa.large_string()))]] = False
            yield b.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminating pairs of all documents and all of benchmark; documents without a row are clean."""
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("contaminated", F.lit(True))
