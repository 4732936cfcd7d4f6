"""Review text files: ``<root>/<dir number>/<file number>.txt``, one tab-joined review per file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit import schemas
from plaudit.scratch import file_place, new_path, store
from plaudit.sources.records import BATCH_BYTES, BATCH_ROWS

# Reviews hold newlines, so stored records end with the ASCII record separator.
RECORD_END = "\x1e"

_PLAIN_PATH = r"([^/]+)/([^/]+)\.txt$"

# Files for which a further task is worth its start, and files that one task reads at most.
FEW_FILES, TASK_FILES = 32, 8192

# Splits of Spark's own reader that one task reads.
TASK_SPLITS = 64

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.threshold"

# Characters of a path that stand encoded in its URI.
_ENCODED = re.compile(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]""")


@contextmanager
def _listed_in_tasks(spark: SparkSession) -> Iterator[None]:
    """Readers made in the block list their folders in tasks, also when these are few with many files."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, "1")
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def _children(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what a folder holds; the names of a local folder are never held together."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.path, info.type == fs.FileType.Directory
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir() or entry.is_file():
                yield entry.path, entry.is_dir()


def _is_read(path: str, folder: bool) -> bool:
    """Whether a reader goes into a folder or reads a file: stray files and, as in Spark's readers, hidden names are left out."""
    name = path.rpartition("/")[2]
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return not hidden and (folder or name.endswith(".txt"))


def _file_names(spark: SparkSession, root: str, found: list[tuple[str, bool]]) -> DataFrame:
    """(path): the text files among ``found`` and in its folders, at any depth, as a stored table.

    One round for each level: tasks list its folders and store what they hold, so the driver gets no
    names, only the number of folders of the next level.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_place(root)
        rows: list[tuple[str, bool]] = []
        for batch in batches:
            for parent in batch.column("path").to_pylist():
                for row in _children(system, parent):
                    if _is_read(*row):
                        rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield packed(rows)
                        rows = []
        yield packed(rows)

    def packed(rows: list[tuple[str, bool]]) -> pa.RecordBatch:
        paths, folders = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], ["path", "folder"])

    kind, place, cores = "path string, folder boolean", new_path(spark, "review-names"), spark.sparkContext.defaultParallelism
    levels = [spark.createDataFrame(found, kind)]
    while folders := levels[-1].where("folder").count():
        above = levels[-1].where("folder").repartition(min(folders, 4 * cores))
        levels.append(store(above.mapInArrow(run, kind), f"{place}/{len(levels)}"))
    return reduce(DataFrame.union, levels).where("NOT folder").select("path")


def _texts(spark: SparkSession, root: str) -> DataFrame:
    """(value, path): the text files under ``root``, listed and read by tasks if Arrow can open the store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = list(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or ())
    if not found:
        return _texts_by_spark(spark, root)  # which says what is missing
    uri = found[0].getPath().toString()
    try:
        _, first = file_place(uri)
    except (pa.ArrowException, OSError):
        return _texts_by_spark(spark, root)
    store_name = uri.removesuffix(first)
    rows = [(file_place(status.getPath().toString())[1], status.isDirectory()) for status in found]
    names = _file_names(spark, uri, [row for row in rows if row[1] or _is_read(*row)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_place(uri)
        values, paths, size = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_file(path) as file:
                    value = file.read()
                # Spark's readers skip empty files.
                if value:
                    values.append(value)
                    paths.append(store_name + _ENCODED.sub(lambda c: quote(c[0], safe=""), path))
                    size += len(value)
                if size > BATCH_BYTES:
                    yield packed(values, paths)
                    values, paths, size = [], [], 0
        yield packed(values, paths)

    def packed(values: list[bytes], paths: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(paths, pa.string())], ["value", "path"])

    files, cores = names.count(), spark.sparkContext.defaultParallelism
    tasks = max(min(4 * cores, files // FEW_FILES + 1), -(-files // TASK_FILES))
    read = names.repartition(tasks, "path").mapInArrow(run, "value binary, path string")
    return read.select(F.col("value").cast("string").alias("value"), "path")


def _texts_by_spark(spark: SparkSession, root: str) -> DataFrame:
    """(value, path), as ``_texts``, by Spark's own reader, which keeps the names of all files on the driver.

    It counts every file as megabytes, so it would make a task of some dozens; these are put together
    to tasks of ``TASK_SPLITS`` of them.
    """
    with _listed_in_tasks(spark):
        texts = (spark.read.option("recursiveFileLookup", True)
                 .option("pathGlobFilter", "*.txt").text(root, wholetext=True)
                 .select("value", F.col("_metadata.file_path").alias("path")))
    splits = texts.rdd.getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    return texts.coalesce(max(4 * cores, -(-splits // TASK_SPLITS)))


def read_review_text_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The (reviews, rejects) of a tree of files; stray files are skipped.

    A file with fewer than nine fields is a reject; tabs inside a review cut it, as the fields
    are told apart by tabs alone. The tree is listed by tasks when this is called, into a stored table
    of names, and read by tasks, so the driver holds no file names. Only in a store that Arrow cannot
    open are the files listed and read by Spark's reader, which needs driver memory for every file.
    """
    return split_review_fields(_texts(spark, root).select(
        "value", "path", F.regexp_extract("path", _PLAIN_PATH, 1).alias("dir"),
        F.regexp_extract("path", _PLAIN_PATH, 2).alias("file")))


def read_review_text_records(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The (reviews, rejects) of packed ``<root>/dir=<n>/`` folders: many records per file, read in splits."""
    records = (spark.read.schema("value STRING, dir STRING").option("lineSep", RECORD_END)
               .text(root)
               .select("value", F.col("_metadata.file_path").alias("path"), "dir",
                       F.lit(None).cast("string").alias("file")))
    return split_review_fields(records)


def split_review_fields(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``value`` into the nine fields; short rows go to the second frame."""
    parts = files.withColumn("fields", F.split("value", "\t"))
    whole = F.size("fields") >= len(schemas.REVIEW_FIELDS)
    reviews = parts.where(whole).select("dir", "file", *[
        F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(schemas.REVIEW_FIELDS)])
    rejects = parts.where(~whole).select("path", "value", F.size("fields").alias("n_fields"))
    return reviews, rejects
