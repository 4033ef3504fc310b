"""Each micro-batch as sorted files, and a sketch that follows a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import write_sorted
from ..spec import SortSpec


def write_sorted_batches(stream: DataFrame, spec: SortSpec, path: str, checkpoint: str, partitions: int | None = None, once: bool = False) -> StreamingQuery:
    """Writes each micro-batch, range-partitioned and sorted, to its own folder: a run for a later merge. A batch that is repeated after a
    failure replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        write_sorted(batch, f"{path}/batch={number}", spec, partitions)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def streaming_kll(stream: DataFrame, column: str, window: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A KLL sketch of a double column for each tumbling window of event time; late rows count until the watermark passes."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window)).agg(F.kll_sketch_agg_double(F.col(column).cast("double")).alias("sketch"), F.count("*").alias("n"))
