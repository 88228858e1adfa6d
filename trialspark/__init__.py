"""Spark-native analytics over per-trial frame sequences."""

__version__ = "0.1.0"
