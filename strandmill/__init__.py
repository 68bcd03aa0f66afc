"""Spark-native quality control for long-read sequencing libraries."""

__version__ = "0.1.0"
