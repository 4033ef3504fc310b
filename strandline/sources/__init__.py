"""Sources and sinks: CSV, Parquet, fixed-length binary records, rows in memory, generated keys, trip records."""

from .files import delimiter, iterate, parquet_length, read_csv, read_parquet, read_text_columns, scan_splits, write_sorted
from .gensort import KEY_BYTES, RECORD_BYTES, read_gensort, write_gensort
from .generate import uniform_records, zipf_keys, zipf_records
from .memory import from_rows
from .trips import TRIP_COLUMNS, normalise_trips, write_trips_csv

__all__ = [
    "KEY_BYTES", "RECORD_BYTES", "TRIP_COLUMNS", "delimiter", "from_rows", "iterate", "normalise_trips", "parquet_length", "read_csv", "read_gensort",
    "read_parquet", "read_text_columns", "scan_splits", "uniform_records", "write_gensort", "write_sorted", "write_trips_csv", "zipf_keys", "zipf_records",
]
