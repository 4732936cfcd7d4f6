"""Review text folders: tab-joined fields, a fixed number of reviews per folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plaudit import schemas
from plaudit.functions.missing import null_to_na
from plaudit.operators.numbering import place_in_groups
from plaudit.scratch import file_place
from plaudit.sources.review_files import RECORD_END

# Fixed value: reviews per folder of the harvest.
DIR_REVIEWS = 30_000


def review_line() -> Column:
    """The nine fields joined by tabs, with ``NA`` for missing ones."""
    return F.concat_ws("\t", *[null_to_na(c) for c in schemas.REVIEW_FIELDS])


def write_review_text_dirs(
    df: DataFrame, path: str, index: str = "fileIndex", dir_reviews: int = DIR_REVIEWS,
) -> None:
    """Folders ``dir=1``, ``dir=2`` ... of ``dir_reviews`` records each, one file per folder.

    One file per review is not kept: millions of tiny files cost more to list than to read. A
    review that holds the record separator fails the job rather than being torn in two.
    """
    line = review_line()
    whole = F.when(F.contains(line, F.lit(RECORD_END)),
                   F.raise_error(F.lit("review holds the record separator"))).otherwise(line)
    (place_in_groups(df, index, dir_reviews, "dir").select(whole.alias("value"), "dir")
     .write.option("lineSep", RECORD_END).partitionBy("dir").text(path))


def write_review_file_tree(df: DataFrame, path: str, dir_column: str, file_column: str) -> None:
    """One file per review, in the layout of the harvest: ``<root>/<dir>/<file>.txt``.

    Each task writes the files of its own rows, under their final names, so a repeated task writes
    the same files again. A folder is made once by the first task that needs it. Rows of one name
    overwrite each other. For packed folders of large sets use ``write_review_text_dirs``.
    """
    rows = df.select(F.col(dir_column).cast("string").alias("dir"), F.col(file_column).cast("string").alias("file"),
                     review_line().cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_place(path)
        made, written = set(), 0
        for batch in batches:
            for folder, name, value in zip(*(batch.column(c).to_pylist() for c in ("dir", "file", "value"))):
                if folder not in made:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{root}/{folder}/{name}.txt", compression=None) as out:
                    out.write(value)
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    rows.mapInArrow(run, "written long").agg(F.sum("written")).collect()
