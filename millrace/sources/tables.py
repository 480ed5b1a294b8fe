"""Reading the tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name``, one file or a folder of them. Columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
