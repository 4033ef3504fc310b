"""Places that the driver and all executors share, for tables that a later step reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is unset, a folder of our own, and only if the driver and its
    executors are one machine: elsewhere a local folder would be another one on each, so it is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_strandline_root", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandline-")
        sc._strandline_root = root
    return root.rstrip("/")


def own_root(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_root(spark)}/strandline/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; each call gets another, so reruns and retries never meet."""
    return f"{own_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, and any executor may be lost after."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *staged_tables: DataFrame | None) -> None:
    """Deletes the files of staged tables that no plan reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = f"{own_root(spark)}/"
    for df in staged_tables:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()} if df is not None else ():
            path = jvm.org.apache.hadoop.fs.Path(f)
            if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
                path.getFileSystem(conf).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has staged. Results that haven't been written yet read it, so it is for the end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
