"""Access to the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder, read lazily so that filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
