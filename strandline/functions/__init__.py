"""Order-preserving byte keys and offset-value codes."""

from .codec import composite_key, days_from_ce, decode_key, decode_text, decode_utf8, encode_key, format_ce_days, split_composite
from .ovc import ovc_column, ovc_fields, ovc_partitions, ovc_runs

__all__ = ["composite_key", "days_from_ce", "decode_key", "decode_text", "decode_utf8", "encode_key", "format_ce_days", "ovc_column", "ovc_fields", "ovc_partitions", "ovc_runs", "split_composite"]
