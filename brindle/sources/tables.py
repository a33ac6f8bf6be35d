"""Table access: one Parquet dataset per table name under a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; filters and projections reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
