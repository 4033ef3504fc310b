"""What a sort did: runs, times, bytes, and how evenly its ranges came out."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SortSpec

log = logging.getLogger(__name__)


def partition_counts(df: DataFrame) -> DataFrame:
    """partition and entries of each partition that has rows."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("entries"))


def partition_imbalance(counts: DataFrame) -> DataFrame:
    """One row of a table of entries: partitions, total, avg, min, max, population standard deviation, its share of the mean in percent, max / min."""
    e = F.col("entries")
    s = counts.agg(F.count("*").alias("partitions"), F.sum(e).alias("total"), F.avg(e).alias("avg"), F.min(e).alias("min"), F.max(e).alias("max"), F.stddev_pop(e).alias("std_dev"))
    return s.withColumn("cv_percent", F.when(F.col("avg") > 0, F.col("std_dev") / F.col("avg") * 100).otherwise(0.0)).withColumn("imbalance", F.when(F.col("min") > 0, F.col("max") / F.col("min")).otherwise(0.0))


@dataclass
class SortStats:
    """Times are wall clock: of the sample for the range bounds, of run generation, of the merge."""

    runs: int = 1
    run_rows: list[int] = field(default_factory=list)
    sample_ms: int | None = None
    run_ms: int | None = None
    merge_ms: int | None = None
    input_rows: int = 0
    input_bytes: int = 0
    write_tasks: int = 0
    read_tasks: int = 0
    entries: list[int] = field(default_factory=list)
    shuffle_write_bytes: int = 0
    shuffle_read_bytes: int = 0
    spill_bytes: int = 0
    peak_memory_bytes: int = 0

    def read_amplification(self) -> float | None:
        """Bytes that the merge reads for each byte that run generation wrote."""
        return self.shuffle_read_bytes / self.shuffle_write_bytes if self.shuffle_write_bytes else None

    def imbalance(self) -> dict[str, float]:
        n = len(self.entries)
        if not n:
            return {}
        mean = sum(self.entries) / n
        dev = (sum((x - mean) ** 2 for x in self.entries) / n) ** 0.5
        lo, hi = min(self.entries), max(self.entries)
        return {"partitions": n, "total": sum(self.entries), "avg": mean, "min": lo, "max": hi, "std_dev": dev, "cv_percent": 100 * dev / mean if mean else 0.0, "imbalance": hi / lo if lo else 0.0}

    def __str__(self) -> str:
        lines = [f"runs {self.runs}, sample {self.sample_ms or 0} ms, generation {self.run_ms or 0} ms in {self.write_tasks} tasks, merge {self.merge_ms or 0} ms in {self.read_tasks}", f"input {self.input_rows} rows, {self.input_bytes} bytes; shuffle written {self.shuffle_write_bytes}, read {self.shuffle_read_bytes}, spilled {self.spill_bytes} bytes"]
        if (a := self.read_amplification()) is not None:
            lines.append(f"read amplification {a:.2f} ({100 * (a - 1):+.1f} %)")
        if len(self.entries) > 1:
            i = self.imbalance()
            lines.append(f"{i['partitions']} partitions: avg {i['avg']:.0f}, min {i['min']}, max {i['max']}, deviation {i['std_dev']:.0f} ({i['cv_percent']:.1f} %), max / min {i['imbalance']:.2f}")
            if len(self.entries) <= 32:
                lines.append(f"entries {self.entries}")
        return "\n".join(lines)


def sort_with_stats(df: DataFrame, spec: SortSpec, partitions: int) -> tuple[DataFrame, SortStats]:
    """The sorted frame and what sorting it took: a run is what one map task sorts into the exchange. Each partition's entries are counted in the
    same job. Times, bytes and numbers of tasks are those that Spark recorded for its two stages."""
    sc = df.sparkSession.sparkContext
    order = spec.order(df)
    out = spec.project(df).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    group = f"sort-{uuid.uuid4().hex}"
    old = sc.getLocalProperty("spark.jobGroup.id")
    sc.setJobGroup(group, "sort with statistics")
    try:
        # counting in the sorted partitions runs the whole sort; Catalyst would drop a sort below a plain aggregate
        got = out.mapInArrow(_count, "partition int, entries long").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", old)
    stats = SortStats(entries=[r["entries"] for r in sorted(got)])
    jvm = sc._jsc.sc()
    jvm.listenerBus().waitUntilEmpty(10_000)
    store = jvm.statusStore()
    for job in sorted(sc.statusTracker().getJobIdsForGroup(group)):
        for number in sc.statusTracker().getJobInfo(job).stageIds:
            stage = store.lastStageAttempt(number)
            if stage.status().toString() != "COMPLETE":
                continue
            took = stage.completionTime().get().getTime() - stage.submissionTime().get().getTime()
            if stage.shuffleWriteRecords():  # run generation
                tasks = store.taskList(number, stage.attemptId(), stage.numTasks())
                metrics = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
                stats.run_rows += [int(m.get().shuffleWriteMetrics().recordsWritten()) for m in metrics if m.isDefined()]
                stats.run_ms = (stats.run_ms or 0) + took
                stats.input_rows, stats.input_bytes = int(stage.inputRecords()), int(stage.inputBytes())
                stats.write_tasks += int(stage.numCompleteTasks())
                stats.shuffle_write_bytes += int(stage.shuffleWriteBytes())
            elif stage.shuffleReadRecords():
                stats.merge_ms = (stats.merge_ms or 0) + took
                stats.read_tasks += int(stage.numCompleteTasks())
                stats.shuffle_read_bytes += int(stage.shuffleReadBytes())
            else:
                stats.sample_ms = (stats.sample_ms or 0) + took
                continue
            stats.spill_bytes += int(stage.diskBytesSpilled())
            stats.peak_memory_bytes = max(stats.peak_memory_bytes, int(stage.peakExecutionMemory()))
    stats.runs = len(stats.run_rows) or 1
    log.info("%s", stats)
    return out, stats


def _count(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    n = sum(b.num_rows for b in batches)
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["partition", "entries"])
