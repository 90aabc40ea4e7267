"""Mail-threat analytics on Spark: every job takes DataFrames and returns a DataFrame."""

__version__ = "0.1.0"
