"""Tables by digest that outlive a session: Parquet, bucketed and sorted by the digest, one row for each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import parts


class DigestStore:
    """A table of digest BINARY and further columns at `path`.

    Its number of buckets and its columns are kept beside the data, so a session with any partition setting goes on with what is there; asking for
    others is an error. close() takes it out of the session's catalog; the data stay.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        about = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
        files = about.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")):
            spark.range(0, 1, 1, 1).select(F.lit(buckets or parts(spark)).cast("int").alias("buckets"), F.lit(columns).alias("columns")).write.mode("overwrite").parquet(f"{path}/about")
        there = spark.read.parquet(f"{path}/about").first()
        if buckets not in (None, there["buckets"]) or columns != there["columns"]:
            raise ValueError(f"{path} has {there['buckets']} buckets of {there['columns']}, not {buckets} of {columns}")
        self.buckets = there["buckets"]
        self.name = f"digest_store_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, {columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/data'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Adds rows of the table's columns whose digests it lacks."""
        (
            rows.select(*self.table().columns).repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", f"{self.path}/data").saveAsTable(self.name)
        )

    def lacking(self, digests: DataFrame) -> DataFrame:
        """Rows of digests (one for each digest) that the table lacks: a sort-merge join that doesn't shuffle the table."""
        return digests.hint("merge").join(self.table().select("digest"), "digest", "left_anti")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()

