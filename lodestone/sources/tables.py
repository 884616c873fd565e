"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that says when a row's file was finished.
ARRIVED = "__arrived"


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def arriving(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table with the modification time of each row's file; filters on it prune files before any is opened."""
    return table(spark, data_dir, name).select("*", F.col("_metadata.file_modification_time").alias(ARRIVED))
