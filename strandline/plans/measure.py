"""Measuring sorts and scans: each setting is warmed up, run a few times and averaged."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from statistics import mean

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import is_sorted
from ..operators.sort import global_sort
from ..spec import SortSpec
from .estimate import estimate_sort_mb
from .policy import POLICIES, SortConfig, partitions_for, policy
from .stats import sort_with_stats

log = logging.getLogger(__name__)


def _timed(run: Callable[[], object], warmups: int, runs: int) -> tuple[float, object]:
    for _ in range(warmups):
        run()
    took, got = [], None
    for _ in range(max(1, runs)):
        began = time.perf_counter()
        got = run()
        took.append(time.perf_counter() - began)
    return mean(took), got


def sort_benchmark(df: DataFrame, spec: SortSpec, memory_mb: list[float], threads: list[int], policies: tuple[str, ...] = POLICIES, warmups: int = 1, runs: int = 3, verify: bool = False) -> list[dict]:
    """A row for each policy, memory and number of threads: partitions, mean seconds, rows a second, MB written and read, imbalance, and, if asked for,
    whether the result is in order."""
    mb = estimate_sort_mb(df, spec)
    out = []
    for name in policies:
        for m in memory_mb:
            for t in threads:
                n = min(4 * t, partitions_for(policy(name, SortConfig(memory_mb=m, dataset_mb=max(mb, 1e-3), max_threads=t)), max(mb, 1e-3))[1])
                took, got = _timed(lambda n=n: sort_with_stats(df, spec, n), warmups, runs)
                stats = got[1]
                rows = sum(stats.entries)
                out.append({
                    "policy": name, "memory_mb": m, "threads": t, "partitions": n, "rows": rows, "seconds": took, "rows_per_second": rows / took,
                    "written_mb": stats.shuffle_write_bytes / 1e6, "read_mb": stats.shuffle_read_bytes / 1e6, "imbalance": stats.imbalance().get("imbalance"),
                    "sorted": is_sorted(global_sort(df, SortSpec(spec.keys, spec.values, spec.descending, spec.nulls_last, n)), spec.key_names(df), spec.descending, spec.nulls_last) if verify else None,
                })
                log.info("%s", out[-1])
    return out


def scan_scaling(read: Callable[[int], DataFrame], partitions: list[int], warmups: int = 1, runs: int = 3) -> list[dict]:
    """A row for each number of partitions: rows, mean seconds, rows a second, and the speed-up over the first. read(n) gives the frame to scan in
    n partitions; each column of each row is read."""
    out: list[dict] = []
    for n in partitions:
        df = read(n)
        took, rows = _timed(lambda df=df: df.agg(F.count("*"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).first()[0], warmups, runs)
        out.append({"partitions": n, "rows": rows, "seconds": took, "rows_per_second": rows / took, "speed_up": (out[0]["seconds"] if out else took) / took})
        if rows != out[0]["rows"]:
            log.warning("%d partitions gave %d rows, %d gave %d", n, rows, partitions[0], out[0]["rows"])
    return out
