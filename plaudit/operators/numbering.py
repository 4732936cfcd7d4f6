"""Running numbers, output parts, numeric name order, top-k and list union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.scratch import materialize

# Files of one directory that are numbered by one task.
BLOCK_BITS = 16

# Rows with texts that one task should write.
TASK_ROWS = 500_000


def running_total(df: DataFrame, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before this one, in a total ``order``, as column ``out``.

    Rows are range-partitioned and written, so that the ranges stay fixed. Each range then adds up
    its own rows, and starts at the sum of the ranges before it: one number per range is all that
    meets in one task or is broadcast, at most ``spark.sql.shuffle.partitions`` of them.
    """
    ranged = (df.withColumn("_value", value).repartitionByRange(*order)
              .withColumn("_range", F.spark_partition_id()))
    ranged = materialize(ranged, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum")).select(
        "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_range_start"))
    inside = (Window.partitionBy("_range").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (ranged.join(F.broadcast(starts), "_range")
            .withColumn(out, F.col("_range_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .drop("_range", "_value", "_range_start"))


def dense_index(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """0-based running number of narrow rows in a total ``order``."""
    return running_total(df, order, F.lit(1).cast("long"), out)


def number_reviews(
    df: DataFrame, directory: str = "dir", file: str = "file", out: str = "fileIndex",
) -> tuple[DataFrame, DataFrame]:
    """0-based running number over (directory, file), both compared as integers.

    Returns (numbered rows, rejects); rejects are the rows whose names are not integers (stray files).
    A directory may hold any share of the files, so it is cut into blocks of 65,536 file numbers.
    Only the block sizes are summed up in order, from the two name columns; the wide rows are
    shuffled once, to be numbered inside their block.
    """
    block = [F.col(directory).try_cast("long").alias("_dir"),
             F.shiftright(F.col(file).try_cast("long"), BLOCK_BITS).alias("_block")]
    marked = df.select("*", *block)
    rows = marked.where("_dir IS NOT NULL AND _block IS NOT NULL")
    rejects = marked.where("_dir IS NULL OR _block IS NULL").drop("_dir", "_block")
    sizes = rows.groupBy("_dir", "_block").agg(F.count("*").alias("_size"))
    starts = running_total(sizes, ["_dir", "_block"], F.col("_size"), "_before")
    starts = materialize(starts.select("_dir", "_block", "_before"), "block-starts")
    inside = Window.partitionBy("_dir", "_block").orderBy(F.col(file).try_cast("long"), file)
    numbered = (rows.join(starts, ["_dir", "_block"])
                .withColumn(out, F.col("_before") + F.row_number().over(inside) - 1)
                .drop("_dir", "_block", "_before"))
    return numbered, rejects


def group_number(index: str, size: int) -> Column:
    """1-based number of the group of ``size`` consecutive rows that a 0-based index falls in."""
    return F.floor(F.col(index) / F.lit(size)) + 1


def place_in_groups(
    df: DataFrame, index: str, size: int, out: str, last_index: int | None = None,
) -> DataFrame:
    """Numbered rows shuffled so that each group of ``size`` is whole and sorted in one task.

    The number of tasks follows the number of rows, not the session's shuffle partitions: at most
    one per group, and otherwise enough for all cores and for ``TASK_ROWS`` rows each. The largest
    index tells how many rows there are; it is looked up, from that one column, if it is not given.
    Rows without an index belong to no group and are dealt out over the tasks by their values.
    """
    if last_index is None:
        last_index = df.agg(F.max(index)).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = min(int(last_index) // size + 1, max(cores, int(last_index) // TASK_ROWS + 1))
    placed = df.withColumn(out, group_number(index, size))
    dealt = F.when(F.col(index).isNull(), F.xxhash64(*df.columns))
    return placed.repartition(tasks, out, dealt).sortWithinPartitions(out, index)


def assign_output_part(df: DataFrame, index: str, part_rows: int, dir_rows: int) -> DataFrame:
    """Output part and directory number of each numbered review."""
    return df.withColumns({"part": group_number(index, part_rows),
                           "dir": group_number(index, dir_rows)})


def sort_numeric_names(df: DataFrame, name: str, out: str = "position") -> DataFrame:
    """Names with their 0-based place in integer order; names that are not integers are dropped."""
    named = df.withColumn("number", F.col(name).try_cast("long")).where(F.col("number").isNotNull())
    return dense_index(named, ["number", name], out)


def top_k(df: DataFrame, n: str, k: int, *keys: str) -> DataFrame:
    """The ``k`` rows with the largest ``n``; ties go by key, so the answer is repeatable."""
    return df.orderBy(F.desc(n), *keys).limit(k)


def union_words(first: DataFrame, second: DataFrame) -> DataFrame:
    """Words of two lists without repeats."""
    return first.union(second).distinct()
