"""Planning a sort before it runs, and figures after: policies, size estimates, statistics, measurements."""

from .estimate import column_bytes, estimate_sort_mb
from .measure import scan_scaling, sort_benchmark
from .policy import POLICIES, PolicyParameters, SortConfig, all_policies, bottleneck, is_feasible, partitions_for, policy, policy_by_name, policy_frame, policy_text, run_count
from .stats import SortStats, partition_counts, partition_imbalance, sort_with_stats
from .units import human_bytes, memory_list

__all__ = [
    "POLICIES", "PolicyParameters", "SortConfig", "SortStats", "all_policies", "bottleneck", "column_bytes", "estimate_sort_mb", "human_bytes",
    "is_feasible", "memory_list", "partition_counts", "partition_imbalance", "partitions_for", "policy", "policy_by_name", "policy_frame", "policy_text", "run_count", "scan_scaling", "sort_benchmark",
    "sort_with_stats",
]
