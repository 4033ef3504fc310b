"""Fixed-length binary records of 100 bytes: a key of 10 and a payload of 90."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _size

#: The record format.
RECORD_BYTES, KEY_BYTES = 100, 10


def read_gensort(spark: SparkSession, path: str) -> DataFrame:
    """key and payload of each record. Splits follow record boundaries, and records stay in the JVM from the file to the frame.

    An empty file gives no rows; a size that isn't a multiple of the record is an error at once.
    """
    size = _size(spark, path)
    if size % RECORD_BYTES:
        raise ValueError(f"{path}: {size} bytes are no multiple of {RECORD_BYTES}")
    if not size:
        return spark.createDataFrame([], "key binary, payload binary")
    sc = spark.sparkContext
    records = sc._jsc.binaryRecords(path, RECORD_BYTES).rdd()
    raw = DataFrame(spark._jsparkSession.createDataset(records, sc._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    return raw.select(F.substring("value", 1, KEY_BYTES).alias("key"), F.substring("value", KEY_BYTES + 1, RECORD_BYTES - KEY_BYTES).alias("payload"))


def _fixed(column: pa.Array, size: int) -> np.ndarray:
    """The column's bytes, a row for each value; all have `size` of them."""
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count or (np.diff(offs) != size).any():
        raise ValueError(f"a record has a key of {KEY_BYTES} and a payload of {RECORD_BYTES - KEY_BYTES} bytes")
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].reshape(-1, size)


def write_gensort(df: DataFrame, path: str) -> None:
    """key and payload as records, a file for each partition, in order; each partition streams to its file in the target's file system."""
    import os
    import uuid

    from pyarrow import fs

    uri = path if "://" in path else f"file://{os.path.abspath(path)}"

    def run(batches):
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(uri)
        where.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():05d}.bin"
        part, n = f"{base}/_{uuid.uuid4().hex}", 0
        with where.open_output_stream(part) as out:
            for b in batches:
                if b.num_rows:
                    out.write(np.hstack([_fixed(b.column(0), KEY_BYTES), _fixed(b.column(1), RECORD_BYTES - KEY_BYTES)]).tobytes())
                n += b.num_rows
        where.move(part, name)
        yield pa.RecordBatch.from_pydict({"rows": [n]})

    df.select("key", "payload").mapInArrow(run, "rows long").agg(F.sum("rows")).collect()
