"""Spark-native text and bibliographic analytics."""

__version__ = "0.1.0"
