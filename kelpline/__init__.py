"""Spark-native indexing, retrieval and corpus-processing engine for source code and text."""

__version__ = "0.1.0"
