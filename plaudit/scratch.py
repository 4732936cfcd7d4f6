"""Written tables in the shared folder: they cut lineage and give Catalyst real sizes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder, else one in the warehouse folder."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
            or spark.conf.get("spark.sql.warehouse.dir"))
    return base.rstrip("/") + "/plaudit"


def new_path(spark: SparkSession, label: str) -> str:
    """A path that no other run uses."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to a path that is new and return the stored table."""
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once and return the stored table.

    A lost executor costs nothing that is already written, and later joins are planned on the
    table's real size, so Spark broadcasts it when it is small and shuffles it when it is not.
    """
    return store(df, new_path(df.sparkSession, label), *partition_by)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no result reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(conf).delete(place, True)


def release_tree(spark: SparkSession, path: str) -> None:
    """Delete a tree with many files: its folders by tasks, as the driver would hold the names of a whole folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatusIterator(place)
    folders = []
    while found.hasNext():
        status = found.next()
        if status.isDirectory():
            folders.append((status.getPath().getName(),))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_place(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                # A repeated task may find that a folder is gone.
                if system.get_file_info(f"{root}/{name}").type == fs.FileType.Directory:
                    system.delete_dir(f"{root}/{name}")
            yield batch

    tasks = max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism))
    spark.createDataFrame(folders, "name string").repartition(tasks).mapInArrow(run, "name string").count()
    release(spark, path)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A folder for stored tables that is deleted at the end of the block, also after an error."""
    path = new_path(spark, label)
    try:
        yield path
    finally:
        release(spark, path)


def file_place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path, for a task that opens a file by the name that Spark gives it."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file":
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^/+", "/", rest if colon else path)
