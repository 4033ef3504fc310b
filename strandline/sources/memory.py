"""Rows in memory as a source."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def from_rows(spark: SparkSession, rows: Iterable[tuple], schema: str | T.StructType = "key binary, value binary", partitions: int | None = None) -> DataFrame:
    """A DataFrame of the rows; `partitions` contiguous slices of them if given."""
    if partitions is not None and partitions < 1:
        raise ValueError("partitions must be 1 or more")
    df = spark.createDataFrame(list(rows), schema)
    return df if partitions is None else df.repartition(partitions)
