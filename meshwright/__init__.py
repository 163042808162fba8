"""Spark-native analytics engine for planning fixed wireless mesh networks."""

__version__ = "0.1.0"
