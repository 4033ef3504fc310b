"""Extension: sorting streams. An unbounded stream has no global order; these sort what is bounded."""

from .batches import streaming_kll, write_sorted_batches

__all__ = ["streaming_kll", "write_sorted_batches"]
