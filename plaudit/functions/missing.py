"""Missing text is the word NA in files and payloads, and null in tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: what the harvest writes for an absent field.
MISSING = "NA"


def na_to_null(column: str | Column) -> Column:
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(MISSING))


def null_to_na(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(MISSING))
