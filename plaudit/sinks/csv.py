"""CSV writers, quoted so that the readers give back every text unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plaudit.operators.numbering import place_in_groups
from plaudit.sources.csv import QUOTING

WRITING = {**QUOTING, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# Fixed value: rows per CSV part of the converter.
PART_ROWS = 500_000


def write_result_csv(df: DataFrame, path: str, *order: str, files: int = 1) -> None:
    """Write a finished result without header in ``files`` files, sorted by ``order`` across them.

    The files hold ranges of the order, so read one after the other they are sorted. The caller
    chooses their number, with the same plan for every size. An existing path is an error.
    """
    placed = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    placed.write.options(**WRITING).csv(path)


def write_csv_rollover(
    df: DataFrame, path: str, index: str = "fileIndex", part_rows: int = PART_ROWS,
) -> None:
    """Headed parts ``part=1``, ``part=2`` ... of ``part_rows`` consecutive rows each.

    Every part is one file, written by one task, and bounded.
    """
    (place_in_groups(df, index, part_rows, "part")
     .write.options(**WRITING).option("header", True).partitionBy("part").csv(path))


def write_review_csv(df: DataFrame, path: str) -> None:
    """All rows with a header, in as many files as there are partitions."""
    df.write.options(**WRITING).option("header", True).csv(path)


def part_sizes(rows: DataFrame, index: str = "fileIndex") -> DataFrame:
    """Rows and index range of each part."""
    return rows.groupBy("part").agg(
        F.count("*").alias("n"), F.min(index).alias("first_index"), F.max(index).alias("last_index"))
