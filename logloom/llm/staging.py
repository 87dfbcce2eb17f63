"""Input tables, and intermediate ones in the folder that all executors and the driver share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.sources.shared import collecting, delete, fresh_path, scratch, shared_dir, stage

__all__ = ["collecting", "delete", "fresh_path", "scratch", "shared_dir", "stage", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
