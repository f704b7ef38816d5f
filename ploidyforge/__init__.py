"""Spark-native single-cell copy-number analytics."""

__version__ = "0.1.0"
