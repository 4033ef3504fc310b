"""CSV and Parquet in, sorted Parquet or CSV out."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SortSpec, picked, resolve

#: Names that stand for delimiters.
DELIMITERS = {"tab": "\t", "\\t": "\t", "pipe": "|", "comma": ","}
#: What a field must look like before it is cast; try_cast alone accepts blanks, suffixes and bare years.
_GUARDS = {
    "int": r"^[+-]?[0-9]+$",
    "float": r"^(?i)[+-]?(inf|infinity|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)$",
    "date": r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$",
}


def delimiter(name: str) -> str:
    sep = DELIMITERS.get(name, name)
    if len(sep) != 1:
        raise ValueError(f"a delimiter is one character, or one of {sorted(DELIMITERS)}")
    return sep


def _size(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    if not found:
        raise FileNotFoundError(path)
    return sum(fs.getContentSummary(x.getPath()).getLength() for x in found)


def _typed(text: Column, kind: T.DataType) -> Column:
    """The field as `kind`, null where it isn't one."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        text = F.coalesce(text, F.lit(""))
        return text.cast(kind)
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.when(text.rlike(_GUARDS["int"]), text.try_cast(kind))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(text.rlike(_GUARDS["float"]), text.try_cast(kind))
    if isinstance(kind, T.DateType):
        return F.when(text.rlike(_GUARDS["date"]), text.try_cast(kind))
    return text.try_cast(kind)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[int | str] | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """The selected columns (all if None) of a CSV file with a given schema.

    A row that lacks a selected column, or whose field there isn't of its type, is left out; columns that aren't selected are never
    looked at, and further fields are ignored. Empty text fields are empty strings. Quotes may be doubled inside quotes; a record is
    one line; blank lines are skipped. A missing or empty file and an empty selection are errors.
    """
    names = [f.name for f in schema.fields]
    picked = names if columns is None else [names[c] if isinstance(c, int) and 0 <= c < len(names) else c for c in columns]
    if not picked:
        raise ValueError("at least one column is needed")
    for c in picked:
        if c not in names:
            raise IndexError(f"no column {c!r}")
    if not _size(spark, path):
        raise ValueError(f"{path} is empty")
    sep = delimiter(sep)
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    # the reader only deals out lines (the separator is no character) and drops headers; fields are cut here, so that a missing field differs
    # from an empty one and unselected fields can't spoil a row
    lines = spark.read.csv(path, schema="line string", sep="\uffff", quote="", escape="", header=header, enforceSchema=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    lines = lines.where(F.length("line") > 0).select(_fields("line", sep).alias("f"))
    at = [names.index(c) for c in picked]
    rows = lines.where(F.size("f") > max(at)).select(*[_typed(_unquoted(F.col("f")[i]), schema[c].dataType).alias(f"v{k}") for k, (i, c) in enumerate(zip(at, picked, strict=True))])
    rows = rows.where(_all([F.col(f"v{k}").isNotNull() for k in range(len(picked))]))
    return rows.toDF(*picked)


def _fields(line: str, sep: str) -> Column:
    """Raw fields of a line: separators inside quotes don't count, an open quote runs to the end. Possessive and unrolled, so that the stack that a
    match needs doesn't grow with the field."""
    s = re.escape(sep) if sep != "\t" else "\\t"
    field = f'[^"{s}]*+(?:"[^"]*+(?:""[^"]*+)*+(?:"|$)[^"{s}]*+)*+'
    return F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f"{s}({field})"), F.lit(1))


def _unquoted(field: Column) -> Column:
    """Without quotes; a doubled one inside quotes is one."""
    return F.replace(F.regexp_replace(field, '"((?:[^"]*+(?:""[^"]*+)*+))(?:"|$)', "$1"), F.lit('""'), F.lit('"'))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def read_text_columns(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A CSV file of unknown schema: all columns as text, named col_0, col_1 and so on."""
    if not _size(spark, path):
        raise ValueError(f"{path} is empty")
    df = spark.read.csv(path, sep=delimiter(sep), header=header, escape='"', inferSchema=False)
    return df.toDF(*[f"col_{i}" for i in range(len(df.columns))]).na.fill("")


def read_parquet(spark: SparkSession, path: str, columns: list[int | str] | None = None) -> DataFrame:
    """Schema from the footer; columns by name or ordinal, checked at once. Only they are read; one asked for again comes again, numbered."""
    df = spark.read.parquet(path)
    return df if columns is None else picked(df, resolve(df, columns))


def parquet_length(spark: SparkSession, path: str) -> int:
    """Number of rows; Spark answers it from the footers."""
    return spark.read.parquet(path).count()


def write_sorted(df: DataFrame, path: str, spec: SortSpec, partitions: int | None = None, kind: str = "parquet") -> None:
    """Range-partitioned, sorted files: their name order is the key order, and row groups and pages carry narrow key ranges."""
    n = partitions or spec.partitions
    keys = spec.order(df)
    (df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)).sortWithinPartitions(*keys).write.format(kind).mode("overwrite").save(path)


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows in order, a partition at a time; may be called again and again."""
    return df.toLocalIterator(prefetchPartitions=True)


def scan_splits(df: DataFrame) -> DataFrame:
    """file, start and rows of each split that a scan of files deals out; a row belongs to one split only."""
    placed = df.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    return placed.groupBy("file", "start").agg(F.count("*").alias("entries"))
