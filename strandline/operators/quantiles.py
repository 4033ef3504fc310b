"""Sketches, samples, quantiles and split points.

Numbers have Spark's KLL sketches, which can be stored, and merged later. Every type that has an order (text, binary and dates too) has an order
sketch: values with weights, few whatever the input, whose tables can be stored, joined and merged again. Exact positions come from ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import global_rank, placed, range_bounds

#: Fixed value: the sketch size parameter.
K = 200


def _kind(df: DataFrame, column: str) -> str:
    t = dict(df.dtypes)[column]
    kind = {"bigint": "bigint", "int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "float", "double": "double"}.get(t)
    if kind is None:
        raise TypeError(f"{column} is {t}: sketches take numbers; use split_points or exact_quantiles")
    return kind


def kll_summary(df: DataFrame, column: str, k: int = K) -> DataFrame:
    """One row: the sketch, its count and its text. Sketches are built in the map tasks and merged."""
    kind = _kind(df, column)
    s = df.agg(getattr(F, f"kll_sketch_agg_{kind}")(column, k).alias("sketch"))
    return s.select("sketch", getattr(F, f"kll_sketch_get_n_{kind}")("sketch").alias("n"), getattr(F, f"kll_sketch_to_string_{kind}")("sketch").alias("text"))


def kll_merge(sketches: DataFrame, kind: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One row: the sketch of all that the stored sketches have seen, its count and its text. kind: bigint, float or double, as they were built."""
    s = sketches.agg(getattr(F, f"kll_merge_agg_{kind}")(column, k).alias("sketch"))
    return s.select("sketch", getattr(F, f"kll_sketch_get_n_{kind}")("sketch").alias("n"), getattr(F, f"kll_sketch_to_string_{kind}")("sketch").alias("text"))


def kll_quantiles(df: DataFrame, column: str, probabilities: list[float], k: int = K) -> DataFrame:
    """p and value: approximate quantiles from one sketch."""
    kind = _kind(df, column)
    s = df.agg(getattr(F, f"kll_sketch_agg_{kind}")(column, k).alias("sketch"))
    get = getattr(F, f"kll_sketch_get_quantile_{kind}")
    return s.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), get("sketch", F.lit(float(p))).alias("value")) for p in probabilities])).alias("q")).select("q.p", "q.value")


def kll_rank(df: DataFrame, column: str, value: float, k: int = K) -> DataFrame:
    """One row: n, the estimated share of values up to `value`, and their estimated number."""
    kind = _kind(df, column)
    s = df.agg(getattr(F, f"kll_sketch_agg_{kind}")(column, k).alias("sketch"))
    n = getattr(F, f"kll_sketch_get_n_{kind}")("sketch")
    share = getattr(F, f"kll_sketch_get_rank_{kind}")("sketch", F.lit(value))
    return s.select(n.alias("n"), share.alias("quantile"), F.round(share * n).cast("long").alias("rank"))


class _Levels:
    """Sorted buffers of k values: those on level l stand for 2 ** l values each. Two full buffers of a level make one of the next: every other
    value of both, from a random one of the first two on."""

    def __init__(self, k: int, seed: int):
        self.k, self.random, self.full, self.loose = k, np.random.default_rng(seed), {}, {}

    def add(self, values: pa.Array, level: int = 0) -> None:
        held = self.loose.pop(level, None)
        values = values if held is None else pa.concat_arrays([held, values])
        while len(values) >= self.k:
            self._push(_ordered(values.slice(0, self.k)), level)
            values = values.slice(self.k)
        if len(values):
            self.loose[level] = values

    def _push(self, buffer: pa.Array, level: int) -> None:
        while level in self.full:
            both = _ordered(pa.concat_arrays([self.full.pop(level), buffer]))
            buffer = both.take(pa.array(np.arange(int(self.random.integers(2)), len(both), 2)))
            level += 1
        self.full[level] = buffer

    def items(self) -> Iterator[tuple[int, pa.Array]]:
        for held in (self.full, self.loose):
            yield from held.items()


def _ordered(values: pa.Array) -> pa.Array:
    return values.take(pc.array_sort_indices(values))


def _reduced(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """value and level, a sketch for each partition of rows of value and level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        levels = _Levels(k, seed + TaskContext.get().partitionId())
        for b in batches:
            value, level = b.column("value"), b.column("level").to_numpy()
            for one in np.unique(level).tolist():
                levels.add(value.filter(pa.array(level == one)), one)
        for level, values in levels.items():
            yield pa.RecordBatch.from_arrays([values, pa.array(np.full(len(values), level, np.int32))], names=["value", "level"])

    return rows.mapInArrow(run, rows.schema)


def order_sketch(df: DataFrame, column: str, k: int = 1024, seed: int = 1) -> DataFrame:
    """value and weight: some of the column's values, each for as many as its weight says; nulls don't count. Any type with an order.

    A rank is off by less than log2(n / k) / k of all in the mean, and the table has about k values for each doubling of the rows beyond k.
    Sketches are made where the rows lie and merged by as many tasks as the root of their number, then by one."""
    rows = df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("value"), F.lit(0).alias("level"))
    return _merged(_reduced(rows, k, seed), k, seed, rows.rdd.getNumPartitions())


def merge_order_sketches(sketches: list[DataFrame], k: int = 1024, seed: int = 1) -> DataFrame:
    """The order sketch of all that the given ones have seen."""
    if not sketches:
        raise ValueError("at least one sketch is needed")
    rows = reduce(DataFrame.union, [s.select("value", F.round(F.log2("weight")).cast("int").alias("level")) for s in sketches])
    return _merged(rows, k, seed, len(sketches))


def _merged(rows: DataFrame, k: int, seed: int, parts: int) -> DataFrame:
    if parts > 64:
        rows = _reduced(rows.repartition(ceil(sqrt(parts))), k, seed + 1)
    return _reduced(rows.coalesce(1), k, seed + 2).select("value", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")).alias("weight"))


def sketch_cdf(sketch: DataFrame) -> DataFrame:
    """value and the share of all up to it, for each value of an order sketch."""
    sums = sketch.groupBy("value").agg(F.sum("weight").alias("_w"))  # a sketch has few rows
    upto = W.partitionBy().orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return sums.select("value", (F.sum("_w").over(upto) / F.sum("_w").over(W.partitionBy())).alias("probability"))


def sketch_quantiles(sketch: DataFrame, probabilities: list[float]) -> DataFrame:
    """p and value from an order sketch, as exact_quantiles gives them from all rows; null without any value."""
    return _quantiles(sketch_cdf(sketch), probabilities)


def sketch_rank(sketch: DataFrame, value) -> DataFrame:
    """One row: n, the estimated share of values up to `value`, and their estimated number."""
    upto = F.coalesce(F.sum(F.when(F.col("value") <= F.lit(value), F.col("weight"))), F.lit(0))
    return sketch.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n"), upto.alias("rank")).select("n", (F.col("rank") / F.nullif("n", F.lit(0))).alias("quantile"), "rank")


def rank_of(column: str | Column, value) -> Column:
    """Exact number of values up to `value`: an aggregate."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum((c <= F.lit(value)).cast("long"))


def cdf(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """value and cumulative probability of each distinct value. Values are counted first, so hot values are one row each."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("_n"))
    rows, (part, at, _) = placed(counts, ["value"], [], ranges=ranges)
    sums = rows.groupBy(part).agg(F.sum("_n").alias("_sum"))  # a row for each range
    before = W.partitionBy().orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(W.partitionBy()).alias("_all"))
    here = F.sum("_n").over(W.partitionBy(part).orderBy(at))
    return rows.withColumn("_here", here).join(F.broadcast(sums), part).select("value", ((F.col("_before") + F.col("_here")) / F.col("_all")).alias("probability"))


def value_at(cdf_table: DataFrame, p: float) -> DataFrame:
    """The least value whose probability reaches p, and the last value if none does. An empty table gives null, not an error."""
    hit = F.min(F.when(F.col("probability") >= p, F.col("value")))
    return cdf_table.agg(F.coalesce(hit, F.max("value")).alias("value"))


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """p and value: the least value at which the share of values up to it reaches p, for any type that has an order. A 0 takes the least value."""
    return _quantiles(cdf(df, column), probabilities)


def _quantiles(table: DataFrame, probabilities: list[float]) -> DataFrame:
    asked = [F.struct(F.lit(float(p)).alias("p"), F.coalesce(F.min(F.when(F.col("probability") >= p - 1e-12, F.col("value"))), F.max("value")).alias("value")) for p in probabilities]
    return table.agg(F.array(*asked).alias("q")).select(F.explode("q").alias("q")).select("q.p", "q.value")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, low, high and n of equal-width bins between the least and the largest value, which is in the last; without empty bins. Equal values are
    in bin 0."""
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    width = 0.0 if lo is None else (hi - lo) / bins
    bin_ = F.lit(0) if not width else F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))
    counted = v.groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    low = F.lit(lo).cast("double") + F.col("bin") * F.lit(width)
    return counted.select("bin", low.alias("low"), (low + F.lit(width)).alias("high"), "n")


def histogram_text(df: DataFrame, column: str, bins: int, width: int = 40) -> str:
    """The histogram as lines of bars."""
    rows = {r["bin"]: r for r in histogram(df, column, bins).collect()}
    if not rows:
        return "Empty sketch"
    lo, hi = min(r["low"] for r in rows.values()), max(r["high"] for r in rows.values())
    if lo == hi:
        return f"All values equal to {lo:g}"
    step, most = next((r["high"] - r["low"] for r in rows.values())), max(r["n"] for r in rows.values())
    first = min(rows)
    base = rows[first]["low"] - first * step
    lines = []
    for i in range(bins):
        n = rows[i]["n"] if i in rows else 0
        lines.append(f"{base + i * step:12.2f} {base + (i + 1) * step:12.2f} {n:10d} {'#' * max(1, n * width // most)}")
    return "\n".join(lines)


def systematic_sample(df: DataFrame, keys: list[str], every: int = 1000, tie: list[str] | None = None) -> DataFrame:
    """Each `every`-th row of the global order, with its position."""
    return global_rank(df, keys, "row_number", "position", tie=tie).where(F.col("position") % every == 0)


def reservoir(df: DataFrame, group: str, slots: int = 100, seed: int = 1) -> DataFrame:
    """Uniform sample of at most `slots` rows of each group: those with the least random numbers. Each map task keeps its own least before
    the shuffle (a top-k by rank that Spark pushes into the tasks as a group limit)."""
    w = W.partitionBy(group).orderBy("_r")
    return df.withColumn("_r", F.rand(seed)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= slots).drop("_r", "_n")


def split_points(df: DataFrame, keys: list[str], parts: int) -> list[tuple]:
    """parts - 1 or fewer keys that cut df into half-open ranges of about equal size, from a sample; any type that has an order."""
    return range_bounds(df, keys, parts)
