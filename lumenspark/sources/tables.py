"""Table scans by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; only Spark opens the path, so any store will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
