"""Spark-native data profiling: column statistics, associations, shape checks and plans as DataFrames."""

__version__ = "0.1.0"
