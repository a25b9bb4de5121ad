"""Spark-native decision layer for web-crawl frontiers."""

__version__ = "0.1.0"
