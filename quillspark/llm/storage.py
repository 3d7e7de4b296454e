"""The given tables, and tables stored to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.storage import drop, held, publish, scratch, shared_dir, store, store_bucketed

__all__ = ["drop", "held", "publish", "scratch", "shared_dir", "store", "store_bucketed", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
