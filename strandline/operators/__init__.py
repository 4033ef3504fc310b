"""Sorting and what follows from order: runs, merges, ranks, ranges, extremes, checks, quantiles."""

from .order import duplicate_flags, is_sorted, order_violations, same_rows
from .quantiles import (
    cdf, exact_quantiles, histogram, histogram_text, kll_merge, kll_quantiles, kll_rank, kll_summary, merge_order_sketches, order_sketch, rank_of, reservoir, sketch_cdf, sketch_quantiles, sketch_rank,
    split_points, systematic_sample, value_at,
)
from .ranges import bucket_by, range_scan
from .ranks import global_rank, range_bounds, rank_by_distinct
from .sort import bottom_k, generate_runs, global_sort, merge_sorted, offset_limit, parallel_merge, sort_column_array, text_sort, top_k

__all__ = [
    "bottom_k", "bucket_by", "cdf", "duplicate_flags", "exact_quantiles", "generate_runs", "global_rank", "global_sort", "histogram",
    "histogram_text", "is_sorted", "kll_merge", "kll_quantiles", "kll_rank", "kll_summary", "merge_order_sketches", "merge_sorted", "offset_limit", "order_sketch", "order_violations",
    "parallel_merge", "range_bounds", "range_scan", "rank_by_distinct", "rank_of", "reservoir", "same_rows", "sketch_cdf", "sketch_quantiles", "sketch_rank", "sort_column_array", "split_points",
    "systematic_sample", "text_sort", "top_k", "value_at",
]
