"""Parquet tables, SQL views and ordered previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table as it lies; filters and column choices reach the scan."""
    return spark.read.parquet(path)


def register_views(**frames: DataFrame) -> None:
    """Name data frames for SQL text, e.g. ``register_views(review=..., product=...)``."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def preview_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a stated order, so a second look shows the same rows."""
    return df.orderBy(*order).limit(n)
