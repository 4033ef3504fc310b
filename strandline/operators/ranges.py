"""Half-open key ranges and buckets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_scan(df: DataFrame, key: str, lower: Any = None, upper: Any = None) -> DataFrame:
    """Rows with lower <= key < upper; None is no bound, and equal bounds give nothing. Both bounds reach the Parquet scan, where
    files that write_sorted made are pruned by row group and page."""
    out = df
    if lower is not None:
        out = out.where(F.col(key) >= F.lit(lower))
    if upper is not None:
        out = out.where(F.col(key) < F.lit(upper))
    return out


def bucket_by(key: Column, bounds: list) -> Column:
    """Number of the half-open range between bounds that key is in: bounds that are at most key. A balanced tree of comparisons, so a row costs
    log2(len(bounds)) of them inside generated code. Null keys are in bucket 0."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))
