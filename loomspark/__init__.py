"""Spark-native operators for conversation records, sample caches and token sequences."""

__version__ = "0.1.0"
