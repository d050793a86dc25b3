"""Readers for the Parquet tables, one folder or file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``; Spark prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
