"""Positions in a global order without sending all rows to one task.

A window without partitions has a single task. Here Spark's range exchange deals the rows into as many ranges as there are shuffle partitions,
each range is sorted and numbered where it lies, and the counts of the ranges before are added. Equal keys are always in one range, so
ranks are exact. The numbered rows are written to the shared folder once: counts and result read the same ranges, and the input is evaluated
once beside the sample that the exchange takes. Long texts are cut to a prefix for that sample and for the bounds, never for the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import staged
from ..spec import directed, each, unused
from .ranges import bucket_by

#: Sampled keys for each range of range_bounds.
PER_RANGE = 40
#: Characters or bytes of a text or binary key that range bounds look at.
PREFIX = 64
KINDS = ("rank", "row_number", "dense_rank", "cume_dist")


def _cuts(df: DataFrame, keys: list[str], descending: list[bool], nulls_last: list[bool]) -> tuple[list[Column], list[bool], list[bool]]:
    """Columns whose order never contradicts that of the keys and whose size is bounded: of a text its prefix and whether there is more; keys
    after a text that was cut say nothing."""
    out, down, last = [], [], []
    cut: Column | None = None
    for k, d, n in zip(keys, descending, nulls_last, strict=True):
        c, kind = F.col(f"`{k}`"), df.schema[k].dataType
        here = c if cut is None else F.when(~cut, c)
        if isinstance(kind, (T.StringType, T.BinaryType)):
            more = F.coalesce(F.length(c) > PREFIX, F.lit(False))
            out += [F.substring(here, 1, PREFIX), more if cut is None else more & ~cut]
            down, last = [*down, d, d], [*last, n, n]
            cut = more if cut is None else cut | more
        else:
            out.append(here)
            down.append(d)
            last.append(n)
    return out, down, last


def placed(df: DataFrame, keys: list[str], tie: list[str], descending: bool | Sequence[bool] = False, nulls_last: bool | Sequence[bool] = False, ranges: int | None = None, edge=None) -> tuple[DataFrame, list[str]]:
    """df in sorted ranges (in the shared folder), with the number of the range, the place in it (from 0), and, with F.min or F.max as `edge`, the first
    or last place of equal keys; and the names of these columns. Ties are ordered by `tie`, ascending."""
    spark = df.sparkSession
    down, last = each(descending, len(keys)), each(nulls_last, len(keys))
    part, at, side = names = unused(df, "_range", "_at", "_edge")
    cuts, cut_down, cut_last = _cuts(df, keys, down, last)
    cut_names = unused(df, *[f"_cut{i}" for i in range(len(cuts))])
    rows = df.withColumns(dict(zip(cut_names, cuts, strict=True)))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *directed(cut_names, cut_down, cut_last)).sortWithinPartitions(*directed(keys, down, last), *directed(tie))
    rows = rows.withColumn(part, F.spark_partition_id())
    rows = rows.withColumn(at, F.monotonically_increasing_id() - F.shiftleft(F.col(part).cast("long"), 33))
    if edge:
        same = W.partitionBy(*cut_names, *[F.col(f"`{k}`") for k in keys])  # the range exchange already has them together
        rows = rows.withColumn(side, edge(at).over(same))
    return staged(rows.drop(*cut_names), "ranges"), names


def global_rank(df: DataFrame, keys: list[str], kind: str = "rank", name: str = "rank", tie: list[str] | None = None, ranges: int | None = None, descending: bool | Sequence[bool] = False, nulls_last: bool | Sequence[bool] = False) -> DataFrame:
    """df with the position of each row in the global order of keys: rank, row_number, dense_rank or cume_dist.

    Ascending with nulls first; `descending` and `nulls_last` change that for all keys, or for each. `tie`: further columns that order equal
    keys, for row_number. A key that very many rows share stays in one range: use rank_by_distinct for those, or row_number, whose ranges
    are cut by the tie columns as well. dense_rank ranks the distinct keys, so there no key is hot.
    """
    if kind not in KINDS:
        raise ValueError(kind)
    down, last = each(descending, len(keys)), each(nulls_last, len(keys))
    if kind == "dense_rank":
        ranked = global_rank(df.select(*[F.col(f"`{k}`") for k in keys]).distinct(), keys, "row_number", "_place", ranges=ranges, descending=down, nulls_last=last)
        return _joined(df, ranked, keys, "_place", name)
    if kind == "row_number" and tie:
        rows, (part, at, side) = placed(df, [*keys, *tie], [], [*down, *[False] * len(tie)], [*last, *[False] * len(tie)], ranges)
    else:
        rows, (part, at, side) = placed(df, keys, [], down, last, ranges, {"rank": F.min, "cume_dist": F.max}.get(kind))
    counts = rows.groupBy(part).agg(F.count("*").alias("_n"))  # a row for each range
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    out = rows.join(F.broadcast(offsets), part)
    place = F.col("_before") + F.col(at if kind == "row_number" else side) + 1
    if kind == "cume_dist":
        place = place / F.col("_all")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (place if kind == "cume_dist" else place.cast("long")).alias(name))


def _joined(df: DataFrame, ranked: DataFrame, keys: list[str], place: str, name: str) -> DataFrame:
    """df with the place of its keys; the skew join splits hot keys."""
    own = unused(df, *[f"_k{i}" for i in range(len(keys))])
    right = ranked.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], F.col(place).cast("long").alias(unused(df, "_at")[0]))
    same = None
    for k, o in zip(keys, own, strict=True):
        here = F.col(f"`{k}`").eqNullSafe(F.col(o))
        same = here if same is None else same & here
    return df.join(right, same).select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col(right.columns[-1]).alias(name))


def rank_by_distinct(df: DataFrame, keys: list[str], name: str = "rank", ranges: int | None = None, descending: bool | Sequence[bool] = False, nulls_last: bool | Sequence[bool] = False) -> DataFrame:
    """rank() where single keys may hold a large part of all rows: keys are counted first (summed in the map tasks), the distinct keys put in order with
    running sums of their counts, and ranks joined back; the skew join splits hot keys."""
    columns = [F.col(f"`{k}`") for k in keys]
    rows, (part, at, _) = placed(df.groupBy(*columns).agg(F.count("*").alias("_n")), keys, [], descending, nulls_last, ranges)
    sums = rows.groupBy(part).agg(F.sum("_n").alias("_all"))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(part, F.coalesce(F.sum("_all").over(before.orderBy(part)), F.lit(0)).alias("_before"))
    here = F.coalesce(F.sum("_n").over(before.partitionBy(part).orderBy(at)), F.lit(0))
    ranked = rows.withColumn("_here", here).join(F.broadcast(offsets), part)
    return _joined(df, ranked.withColumn("_place", F.col("_before") + F.col("_here") + 1), keys, "_place", name)


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(None).cast(kind) if value is None else F.lit(value).cast(kind)


def range_bounds(df: DataFrame, keys: list[str], ranges: int, seed: int = 7) -> list[tuple]:
    """Up to ranges - 1 rising key tuples that cut df into ranges of about equal size; works for every type that has an order.

    The sample of about PER_RANGE keys for each range is sorted and cut in the executors, and only the cuts reach the driver. Texts are cut to
    PREFIX: a shorter text separates as well."""
    n = df.count()
    want = PER_RANGE * ranges
    if not n or ranges < 2:
        return []
    share = min(1.0, 1.2 * want / n)
    short = [F.substring(f"`{k}`", 1, PREFIX).alias(k) if isinstance(df.schema[k].dataType, (T.StringType, T.BinaryType)) else F.col(f"`{k}`") for k in keys]
    picked = df.select(*short).sample(fraction=share, seed=seed) if share < 1 else df.select(*short)
    ranked = global_rank(picked, keys, "row_number", "_place")
    size = ranked.count()
    step = F.floor((F.col("_place") - 1) * ranges / size)
    at = ranked.where((F.col("_place") > 1) & (step > F.floor((F.col("_place") - 2) * ranges / size)))
    got = [tuple(r)[:-1] for r in at.select(*keys, "_place").orderBy("_place").collect()]
    return [c for i, c in enumerate(got) if i == 0 or c != got[i - 1]]


def range_number(df: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """The range that a row is in: a column to partition by. Struct comparison puts nulls first, as the order does."""
    fields = [df.schema[k].dataType for k in keys]
    as_struct = lambda values: F.struct(*[v.alias(k) for k, v in zip(keys, values, strict=True)])
    cuts = [as_struct([_literal(v, t) for v, t in zip(b, fields, strict=True)]) for b in bounds]
    return bucket_by(as_struct([F.col(f"`{k}`") for k in keys]), cuts)
