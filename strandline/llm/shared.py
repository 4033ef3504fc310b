"""The small helpers that every operator uses, beside those for shared places and column names."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, fresh, shared_root, staged
from ..spec import unused

__all__ = ["SPACE", "bounded_batches", "discard", "fold", "fresh", "integer_ids", "parts", "ranges", "shared_root", "staged", "text_or_empty", "unused"]


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranges(spark: SparkSession, entries: int, each: int) -> int:
    """Hash ranges for so many entries, of which a task holds about `each`: they follow the input, and are as many as shuffle partitions at least."""
    return max(parts(spark), -(-entries // each))


def integer_ids(df: DataFrame, column: str) -> None:
    """Raises for ids that aren't whole numbers, which is what links and their least ids are made of."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{column} is {kind.simpleString()}: ids are whole numbers here")


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches between the JVM and Python workers hold `size` bytes at most (or one row), however long texts are; unless the
    application was started with a bound of its own. Workers get this package's place on their path."""
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{here}:{env.get('PYTHONPATH', '')}".rstrip(":")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(size))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds).cast("long")).cast("int")


#: The white space of every contract here, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
