"""Parity sketches: an exact lower bound of how much two sets differ.

A sketch has, for each of its bits, the parity of the elements that hash to it. An element in one of two sets only turns one bit of their
sketches apart, so the sets differ in as many elements at least as the sketches do in bits: a pair that the sketches rule out is
none, however short or long the sets are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs as B
from . import kernel as K
from .shared import fresh, ranges

_U = np.uint64
#: Bits of a long sketch, and sketches of a file, about.
LONG, FILE = 2048, 100_000


def spark_hash(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for longs. The five primes of that hash and Spark's seed."""
    p1, p2, p3, p4, p5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, k: (v << _U(k)) | (v >> _U(64 - k))
    with np.errstate(over="ignore"):
        h = (_U(42) + p5 + _U(8)) ^ (turned(x.view(_U) * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> _U(33))) * p2
        h = (h ^ (h >> _U(29))) * p3
        return h ^ (h >> _U(32))


def parities(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set `bits` bits (a power of two), each the parity of the elements that hash to it, and its size. Two sets differ in as many elements at least as
    their parities differ in bits."""
    size, out = np.array([len(s) for s in sets], np.int64), np.zeros((len(sets), bits // 8), np.uint8)
    step = max(1, (1 << 23) // bits)
    for lo in range(0, len(sets), step):
        part = sets[lo : lo + step]
        at = (K.mix(np.concatenate(part)) & _U(bits - 1)).astype(np.int64) + np.repeat(np.arange(len(part)) * bits, size[lo : lo + step])
        out[lo : lo + step] = np.packbits((np.bincount(at, minlength=len(part) * bits) & 1).astype(np.uint8).reshape(len(part), bits), axis=1)
    return out, size


def allowance(n: np.ndarray, similar: int) -> np.ndarray:
    """Twice the elements that a set of n may add to the difference from one of a Jaccard similarity of `similar` percent, and rounding."""
    return 2 * n * (100 - similar) // (100 + similar) + 1


class LongParities:
    """Long parities of all rows of a table of id and text, in files by hash of the ids, as many as `entries` rows need; looked up by binary search in the
    mapped files. sets(texts) gives the set of each text."""

    def __init__(self, rows: DataFrame, sets: Callable[[pa.Array], list[np.ndarray]], similar: int, entries: int = 0):
        spark = rows.sparkSession
        self.root, self.similar, self.n = fresh(spark, "parities"), similar, ranges(spark, entries, FILE)
        root, n = self.root, self.n

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, bits, sizes = [], [], []
            for b in batches:
                ids.append(spark_hash(b.column("id").to_numpy()))
                p, k = parities(sets(b.column("text")), LONG)
                bits.append(p)
                sizes.append(k)
            if ids and sum(map(len, ids)):
                ids = np.concatenate(ids)
                order = np.argsort(ids)
                size = np.concatenate(sizes)[order]
                twice = ids[order][1:] == ids[order][:-1]
                size[:-1][twice] = size[1:][twice] = 1 << 40  # an id with two texts: its sketch rules nothing out
                B.put(f"{root}/{int(ids[0].view(np.int64) % n)}", np.array([len(ids)]), ids[order], size, np.concatenate(bits)[order])
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64())], names=["n"])

        bucket = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(n).cast("long")).cast("int")
        rows.select("id", "text").repartitionById(n, bucket).mapInArrow(write, "n long").agg(F.sum("n")).first()

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parity words and sizes of ids."""
        ids, back = np.unique(spark_hash(ids), return_inverse=True)
        bits, size = np.zeros((len(ids), LONG // 64), _U), np.zeros(len(ids), np.int64)
        for k, part in B.dealt((ids.view(np.int64) % self.n).astype(np.int64), self.n):
            raw = B.mapped(f"{self.root}/{k}")
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            at = np.searchsorted(np.frombuffer(raw, _U, n, 8), ids[part])
            size[part] = np.frombuffer(raw, np.int64, n, 8 + 8 * n)[at]
            bits[part] = np.frombuffer(raw, _U, n * LONG // 64, 8 + 16 * n).reshape(n, -1)[at]
        return bits[back], size[back]

    def refine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            (p, n), (q, m) = self.rows(a[part]), self.rows(b[part])
            keep[part] = 2 * np.bitwise_count(p ^ q).sum(1, dtype=np.int64) <= allowance(n, self.similar) + allowance(m, self.similar)
        return keep
