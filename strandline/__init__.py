"""strandline: sorting and order-based analytics on Spark DataFrames."""

__version__ = "0.1.0"
