"""Stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet, optionally in one folder per facet value, so that a facet search reads one folder.

    Every task writes its own rows into the folders, so a value that most rows share is no hot spot.
    """
    df.write.partitionBy(*partition_by).parquet(path)
