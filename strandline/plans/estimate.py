"""How many bytes a sort of some columns has to move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SortSpec

_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.BooleanType: 1, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}


def column_bytes(df: DataFrame, column: str) -> Column:
    """Encoded bytes of a value: text and binary their length and 2, others their width and 1."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 2
    return F.lit(_WIDTH.get(type(kind), 8) + 1).cast("long")


def estimate_sort_mb(df: DataFrame, spec: SortSpec, rows: int | None = None, sample: int = 1000) -> float:
    """Rows times the mean size over a sample of about `sample` rows (all if `rows` is unknown and the frame is smaller)."""
    names = [*spec.key_names(df), *[c for c in spec.project(df).columns if c not in spec.key_names(df)]]
    total = rows if rows is not None else df.count()
    if not total:
        return 0.0
    picked = df.select(*names).sample(min(1.0, sample / total), seed=3) if total > sample else df.select(*names)
    size = sum((column_bytes(df, c) for c in names[1:]), column_bytes(df, names[0]))
    mean = picked.agg(F.avg(size)).first()[0] or 0.0
    return total * mean / 1024**2
