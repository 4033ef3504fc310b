"""Checks of order and content."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import directed, each


def _before(x: pa.Array, y: pa.Array, down: bool, nulls_last: bool | None) -> tuple[np.ndarray, np.ndarray]:
    """Where x comes after y in the order of one key, and where both are equal. NaN is the largest number and equals itself; with nulls_last None, nulls
    are compared with nothing."""
    if pa.types.is_boolean(x.type):
        x, y = x.cast(pa.int8()), y.cast(pa.int8())
    xn, yn = (pc.is_null(v).to_numpy(zero_copy_only=False) for v in (x, y))
    above = pc.greater(x, y).fill_null(False).to_numpy(zero_copy_only=False)
    below = pc.less(x, y).fill_null(False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(x.type):
        xo, yo = (pc.is_nan(v).fill_null(False).to_numpy(zero_copy_only=False) for v in (x, y))
        above, below = above | (xo & ~yo & ~yn), below | (yo & ~xo & ~xn)
    equal = (xn & yn) | ~(xn | yn | above | below)
    after = below if down else above
    if nulls_last is not None:
        after = after | ((xn & ~yn) if nulls_last else (~xn & yn))
    return after, equal


def _ends(df: DataFrame, keys: list[str], descending: list[bool], nulls_last: list[bool | None]) -> DataFrame:
    """For each partition its number, rows, rows that come after the next one although they should not, and its first and last keys. Rows are
    compared where they lie: no exchange."""
    rows = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    for f in rows.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            raise TypeError(f"{f.dataType.simpleString()} keys aren't compared")
    key = T.StructType(rows.schema.fields)
    schema = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("bad", T.LongType()), T.StructField("first", key), T.StructField("last", key)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, bad, first, last = 0, 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            seen = pa.concat_batches([last, b]) if last is not None else b
            first = b.slice(0, 1) if first is None else first
            last = b.slice(b.num_rows - 1)
            n += b.num_rows
            wrong, same = np.zeros(seen.num_rows - 1, bool), np.ones(seen.num_rows - 1, bool)
            for c, d, e in zip(seen.columns, descending, nulls_last, strict=True):
                after, equal = _before(c.slice(0, len(c) - 1), c.slice(1), d, e)
                wrong |= same & after
                same &= equal
            bad += int(wrong.sum())
        if n:
            one = [pa.StructArray.from_arrays(x.columns, names=x.schema.names) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([bad]), *one], names=["p", "n", "bad", "first", "last"])

    return rows.mapInArrow(run, schema)


def _after(x: Column, y: Column, keys: int, descending: list[bool], nulls_last: list[bool | None]) -> Column:
    """Whether x comes after y; both are structs of keys."""
    out: Column = F.lit(False)
    for i in reversed(range(keys)):
        a, b = x[f"k{i}"], y[f"k{i}"]
        apart = F.coalesce((a < b) if descending[i] else (a > b), F.lit(False))
        empty = F.lit(False) if nulls_last[i] is None else a.isNull() & b.isNotNull() if nulls_last[i] else a.isNotNull() & b.isNull()
        out = apart | empty | (a.eqNullSafe(b) & out)
    return out


def _violations(df: DataFrame, keys: list[str], descending: bool | Sequence[bool], nulls_last: bool | Sequence[bool] | None) -> DataFrame:
    """n_rows and n_violations of the order that df's partitions, and the rows in them, have."""
    down, last = each(descending, len(keys)), [None] * len(keys) if nulls_last is None else each(nulls_last, len(keys))
    across = W.partitionBy().orderBy("p")  # a row for each partition
    seen = _ends(df, keys, down, last).select("n", "bad", F.coalesce(_after(F.lag("last").over(across), F.col("first"), len(keys), down, last) & F.lag("last").over(across).isNotNull(), F.lit(False)).alias("gap"))
    return seen.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.sum(F.col("bad") + F.col("gap").cast("long")), F.lit(0)).cast("long").alias("n_violations"))


def order_violations(df: DataFrame, key: str, by: list[str], within: list[str] | None = None) -> DataFrame:
    """Rows whose key is less than that of the row before, in the order of `by` (within groups if given): n_rows and n_violations. Null keys
    are compared with nothing. Without groups the rows are sorted in ranges and compared where they then lie."""
    if not within:
        return _violations(df.select(*dict.fromkeys([key, *by])).repartitionByRange(*directed(by)).sortWithinPartitions(*directed(by)), [key], False, None)
    seen = df.select("*", F.lag(key).over(W.partitionBy(*within).orderBy(*by)).alias("_before"))
    return seen.agg(F.count("*").alias("n_rows"), F.sum((F.col(key) < F.col("_before")).cast("long")).alias("n_violations"))


def is_sorted(df: DataFrame, keys: list[str], descending: bool | Sequence[bool] = False, nulls_last: bool | Sequence[bool] = False) -> bool:
    """Whether partitions in their order, and rows in theirs, are in key order. Each partition is read where it lies and reduced to its first and
    last key and a count, so only one row for each partition is compared at the end. Without rows it is."""
    return _violations(df, keys, descending, nulls_last).first()["n_violations"] == 0


def duplicate_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with `duplicate`: an equal key comes before it in the order. Partitioned by the key itself, so no global window is needed."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*keys))
    return df.withColumn("duplicate", first > 1)


def _digest(df: DataFrame) -> tuple:
    h: Column = F.xxhash64(*[F.col(c) for c in df.columns])
    return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), h).cast("decimal(38,0)"))).first())


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows as often, in any order: by count and sums of row hashes, without a shuffle of rows."""
    return _digest(a) == _digest(b)
