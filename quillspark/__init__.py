"""Spark-native full-text search and text-curation engine."""

__version__ = "0.1.0"
