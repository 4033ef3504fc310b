"""Mixing sources to target weights by subset-sum budget fitting.

Each source's documents are counted by exact size. Whole repeats of a source come first; the rest of its budget is spread over the
sizes in proportion, then a bounded knapsack over the sizes fits what is left (or more of the budget, until the fit is the best there is), and each size's quota is met by the documents that
come first in a seeded order. Only (source, size, count) rows meet in one group; documents never do: they are ranked within
salted parts of their size.

Defined cases: a null text has size 0; the null source is a source of its own, last in order; documents of size 0 take 0 words. Rows
repeated, and rows without an id, are documents of their own. An empty table gives no rows. A source of size 0 has target 0. Reruns agree, as the order
is a hash of the seed and doc_id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import global_rank
from .shared import bounded_batches, ranges, staged, text_or_empty

#: Words that whole documents leave to the dynamic programme at first, where they can; it covers more where that doesn't fit exactly.
REACH = 32_768
#: Documents of a part in which those of a size are ranked, about, if they were all of one size.
EACH = 200_000


def quotas(sizes: np.ndarray, counts: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """How many documents of each size to take, so that the sum of their sizes comes as near to budget as any can.

    Proportional shares first, then the largest sizes that fit while more than reach is left, then a bounded knapsack on what is left, however much.
    As long as that misses the least distance that a sum can have by the sizes' common divisor, the knapsack covers more: first what the large sizes took,
    then half of the shares each time, at last the whole budget, for which its answer is the best there is.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    unit = int(np.gcd.reduce(sizes[(sizes > 0) & (counts > 0)]))
    least = min(budget % unit, -budget % unit)
    share = np.array([int(n) * int(budget) // total for n in counts], np.int64)
    take = share.copy()
    left = budget - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= reach:
            break
        if sizes[i] > 0 and (n := min(int(counts[i] - take[i]), int((left - reach // 2) // sizes[i]))) > 0:
            take[i] += n
            left -= n * int(sizes[i])
    best, off = take, left
    while True:
        left = budget - int((sizes * take).sum())
        if (more := fitted(sizes, counts - take, left, off)) is not None:
            best = take + more
            off = abs(left - int((sizes * more).sum()))
        if off <= least or not (sizes * take).any():
            return best
        take = share if (take > share).any() else take // 2


def fitted(sizes: np.ndarray, spare: np.ndarray, left: int, off: int) -> np.ndarray | None:
    """How many of the spare documents of each size bring their sum nearest to left; None where none is nearer than off."""
    room = left + off - 1
    fit = np.flatnonzero((sizes > 0) & (spare > 0) & (sizes <= room))
    if off <= 0 or not len(fit):
        return None
    few = np.log2(spare[fit] + 1.0).sum() < np.log2(room) - 3  # then the sums themselves take less memory than a mark for each number up to room
    sums, came = np.zeros(1, np.int64), np.full(1, -1, np.int32)
    reached, last = np.zeros(0 if few else room + 1, bool), np.full(0 if few else room + 1, -1, np.int32)
    reached[:1] = True
    steps: list[tuple[int, int]] = []
    for i in fit:
        n, k = min(int(spare[i]), room // int(sizes[i])), 1
        while n > 0:
            k = min(k, n)
            w = k * int(sizes[i])
            if few:
                new = np.setdiff1d(sums[sums <= room - w] + w, sums, assume_unique=True)
                sums, came = np.concatenate([sums, new]), np.concatenate([came, np.full(len(new), len(steps), np.int32)])
            elif w <= room:
                new = np.zeros_like(reached)
                new[w:] = reached[:-w]
                new &= ~reached
                last[new] = len(steps)
                reached |= new
            steps.append((int(i), k))
            n, k = n - k, 2 * k
        if not few and reached[left]:
            break
    ends = sums if few else np.flatnonzero(reached)
    at = int(ends[np.argmin(np.abs(ends - left))])
    if abs(at - left) >= off:
        return None
    last = dict(zip(sums.tolist(), came.tolist(), strict=True)) if few else last
    more = np.zeros(len(sizes), np.int64)
    while at:
        i, k = steps[last[at]]
        more[i] += k
        at -= k * int(sizes[i])
    return more


def targets(totals: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """rank, source, source_size, target, for one row per source. All sizes are shared by weight; a target stops at `most` times its
    source's size and the excess goes to the others by weight.

    Sources are numbered by a distributed rank. What a weight of 1 gets, the level, rises as sources turn out to be below it: each round sums
    those that are not, until nothing changes; the driver sees two sums a round."""
    named = global_rank(totals, ["source"], "row_number", "rank", nulls_last=True)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    named = staged(named.select(F.col("rank").cast("int").alias("rank"), "source", "source_size", weight.alias("weight")), "sources")
    everything, level = float(named.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        held, open_ = named.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        risen = (everything - held) / open_ if open_ else float("inf")
        if risen <= level:
            break
        level = risen
    target = cap if level == float("inf") else F.least(cap, F.lit(level) * F.col("weight"))
    return named.select("rank", "source", "source_size", target.alias("target"))


def sizes(column: str) -> Column:
    """Words of a text."""
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", key: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs, and its `key`, if one is given that tells rows apart. A document is used
    taken / size times."""
    bounded_batches(docs.sparkSession)
    keys = [] if key is None else ["key"]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), sizes(text_column).alias("size"), *([] if key is None else [key.alias("key")]))
    rows = staged(rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    salts = ranges(docs.sparkSession, rows.count(), EACH)
    rows = rows.withColumn("salt", F.pmod("order", F.lit(salts).cast("long")).cast("int"))
    cells = staged(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "size_counts")
    per_source = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = staged(targets(per_source, weights, most), "targets")
    goal = goal.withColumn("repeats", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.when(F.col("repeats") >= most, 0).otherwise(F.round(F.col("target") - F.col("repeats") * F.col("source_size"))).cast("long"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    lengths = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    lengths = lengths.join(goal, same(lengths, goal)).select("rank", "budget", "size", "n")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", kind="stable")
        take = quotas(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), int(group["budget"].iloc[0]))
        return pd.DataFrame({"rank": group["rank"], "size": group["size"], "quota": take})

    quota = lengths.groupBy("rank").applyInPandas(fit, "rank int, size long, quota long")
    parts = cells.join(goal, same(cells, goal)).select("rank", "size", "salt", "n").join(quota, ["rank", "size"])
    before = F.sum("n").over(W.partitionBy("rank", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("rank", "size", "salt", (F.col("quota") - F.coalesce(before, F.lit(0))).alias("quota"))
    ranked = rows.join(goal, same(rows, goal)).select(*keys, "doc_id", "order", "salt", "size", "rank", "source_size", "target", "repeats")
    place = F.row_number().over(W.partitionBy("rank", "size", "salt").orderBy("order", "doc_id"))
    ranked = ranked.withColumn("place", place).join(parts, ["rank", "size", "salt"])
    times = F.col("repeats") + (F.col("place") <= F.col("quota")).cast("long")
    return ranked.select(*keys, "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1 repeating, at most 3 times each."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
