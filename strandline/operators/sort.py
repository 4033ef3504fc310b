"""Global sort, runs, merges, and the first and last rows of an order.

Spark range-partitions first and sorts each partition after (spilling when it must), so the phases of an external merge sort come in
another order with the same result. The plain method and the one with offset-value codes give the same rows; the second derives the codes from
the sorted rows (strandline.functions.ovc).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import composite_key
from ..functions.ovc import ovc_partitions
from ..spec import SortSpec, each, resolve

_TIE, _KEY = "_source_order", "_key_bytes"


def global_sort(df: DataFrame, spec: SortSpec) -> DataFrame:
    """Keys and payload in key order. With a partition count the range exchange has just that many; a stable sort breaks ties by source order.

    The method "ovc" adds `ovc`, the code of each row's composite key after the row before; it begins anew in each range. Codes follow ascending
    bytes, so that method takes no other direction."""
    out, order = spec.project(df), spec.order(df)
    names = out.columns
    if spec.method == "ovc":
        if any([*each(spec.descending, len(order)), *each(spec.nulls_last, len(order))]):
            raise ValueError("offset-value codes are for ascending keys with nulls first")
        out = out.withColumn(_KEY, composite_key(out, spec.key_names(df)))
    if spec.stable:
        out = out.withColumn(_TIE, F.monotonically_increasing_id())
        order = [*order, F.col(_TIE).asc()]
    out = out.repartitionByRange(spec.partitions, *order).sortWithinPartitions(*order) if spec.partitions else out.orderBy(*order)
    if spec.method == "ovc":
        return ovc_partitions(out, _KEY).select(*names, "ovc")
    return out.select(*names)


def generate_runs(df: DataFrame, spec: SortSpec, runs: int | None = None) -> DataFrame:
    """Sorted runs: each partition in key order, with its number as run_id. Rows stay where they are unless a number of runs is given."""
    out = spec.project(df)
    if runs is not None:
        if runs < 1:
            raise ValueError("runs must be 1 or more")
        out = out.repartition(runs)
    return out.withColumn("run_id", F.spark_partition_id()).sortWithinPartitions(*spec.order(df))


def parallel_merge(runs: DataFrame, spec: SortSpec, partitions: int) -> DataFrame:
    """Runs merged into disjoint key ranges, each sorted; partition order is key order."""
    if partitions < 1:
        raise ValueError("partitions must be 1 or more")
    order = spec.order(runs)
    return runs.drop("run_id").repartitionByRange(partitions, *order).sortWithinPartitions(*order)


def merge_sorted(inputs: list[DataFrame], spec: SortSpec, schema: str = "key binary, value binary") -> DataFrame:
    """Any number of inputs merged in key order; ties come in the order of the inputs, which `src` numbers from 0. None gives no rows, in the
    columns of `schema`."""
    if not inputs:
        return SparkSession.active().createDataFrame([], f"{schema}, src int")
    tagged = [spec.project(x).withColumn("src", F.lit(i)) for i, x in enumerate(inputs)]
    both = reduce(DataFrame.unionByName, tagged)
    return both.orderBy(*spec.order(both), "src")


def top_k(df: DataFrame, spec: SortSpec, k: int) -> DataFrame:
    """The first k rows of the order: each task keeps k, and k of each meet (TakeOrderedAndProject)."""
    return spec.project(df).orderBy(*spec.order(df)).limit(k)


def bottom_k(df: DataFrame, spec: SortSpec, k: int) -> DataFrame:
    """The last k rows of the order, in order."""
    n = len(spec.keys)
    back = SortSpec(spec.keys, spec.values, [not x for x in each(spec.descending, n)], [not x for x in each(spec.nulls_last, n)])
    last = spec.project(df).orderBy(*back.order(df)).limit(k)
    return last.orderBy(*spec.order(last))


def offset_limit(df: DataFrame, spec: SortSpec, offset: int, limit: int) -> DataFrame:
    """`limit` rows of the order after the first `offset`."""
    return spec.project(df).orderBy(*spec.order(df)).offset(offset).limit(limit)


def sort_column_array(column: str | Column) -> Column:
    """An array column's elements in order, for lists small enough to be one value."""
    return F.array_sort(column)


def text_sort(df: DataFrame, columns: list[int | str], partitions: int | None = None) -> DataFrame:
    """All columns, in the order of the text forms of some, compared byte by byte: what a line sort on fields of a file gives. Nulls are empty."""
    keys = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).asc() for c in resolve(df, columns)]
    return df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys) if partitions else df.orderBy(*keys)
