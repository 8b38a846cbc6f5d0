"""reviewlens: aspect-based review sentiment analytics on Spark DataFrames."""

__version__ = "0.1.0"
