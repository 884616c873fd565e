"""Lodestone: a Spark-first engine for retrieval, change tracking and text corpora."""

__version__ = "0.1.0"
