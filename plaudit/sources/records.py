"""Records of quoted text files, read in splits although newlines may stand inside quotes.

A line alone does not tell whether it starts inside quotes. What a split does to either case is
a small fact, though: one pass finds it for every split, a running product over the splits of a
file tells how each one starts, and a second pass cuts the records. Only records that go on over
the edge of a split meet other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from plaudit.scratch import new_path, store

# Rows and bytes after which a task hands on the records that it has cut.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20

CORRUPT = "_corrupt"


def ends_inside(line: bytes, inside: bool, separator: bytes = b",") -> bool:
    """Whether quotes are open at the end of a line, given whether they are open at its start.

    Quotes open at the start of a field and close at the next quote that is not doubled; a quote
    elsewhere is a character like others.
    """
    if b'"' not in line:
        return inside
    pieces = line.replace(b'""', b"").split(b'"')
    first = not inside
    for piece in pieces[:-1]:
        inside = not inside and (piece.endswith(separator) or (first and not piece))
        first = False
    return inside


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, T.StructType]:
    """(file, start, folder, value): the lines of all files, in order inside each split.

    ``folder`` holds the values of partition folders as JSON; their fields are the second result.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    folders = T.StructType([field for field in lines.schema if field.name != "value"])
    folder = F.to_json(F.struct(*folders.names)) if len(folders) else F.lit(None).cast("string")
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        folder.alias("folder"), "value"), folders


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], slice]]:
    """((file, start), rows) of the neighbouring rows of a batch that come from one split."""
    file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
    edges = np.nonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1]))[0] + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(file)]):
        if high > low:
            yield (int(file[low]), int(start[low])), slice(low, high)


def split_states(lines: DataFrame, separator: str = ",") -> DataFrame:
    """(file, start, inside, opener): how each split starts, and where a record begins that is open there.

    One row for each split, as large as one part in a million of the files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            # Lines without quotes change nothing, so they are sent as empty ones.
            values = batch.column("value").cast(pa.binary()).to_pylist()
            for split, rows in _stretches(batch):
                if split != held:
                    if held:
                        yield row(held, state)
                    held, state = split, [False, True, False]
                for line in values[rows]:
                    if line:
                        state[0] = ends_inside(line, state[0], separator.encode())
                        state[1] = ends_inside(line, state[1], separator.encode())
                        state[2] |= not state[1]
        if held:
            yield row(held, state)

    def row(split: tuple[int, int], state: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((*split, *state), (pa.int64(), pa.int64(), *[pa.bool_()] * 3))],
            ["file", "start", "from_outside", "from_inside", "leaves"])

    quoted = lines.withColumn("value", F.when(F.contains("value", F.lit('"')), F.col("value")).otherwise(""))
    found = quoted.mapInArrow(run, "file long, start long, from_outside boolean, from_inside boolean, leaves boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # A split that ends alike from either start settles the state; from there on swaps are counted.
    settles = F.col("from_outside") == F.col("from_inside")
    swaps = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("long"))
    counted = found.withColumn("swaps", F.coalesce(swaps.over(before), F.lit(0)))
    settled = F.last(F.when(settles, F.struct(F.col("from_outside").cast("long").alias("state"), "swaps")), ignorenulls=True).over(before)
    started = counted.withColumn("settled", settled).withColumn("inside", F.pmod(
        F.coalesce("settled.state", F.lit(0)) + F.col("swaps") - F.coalesce("settled.swaps", F.lit(0)), F.lit(2)) == 1)
    begins = F.when(~F.col("inside") | F.col("leaves"), F.col("start"))
    return started.withColumn("opener", F.last(begins, ignorenulls=True).over(before)).select("file", "start", "inside", "opener")


def read_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    r"""(record, header, ...): the records of all files under ``path`` without their line ends.

    Further columns are those of partition folders. Lines end with \n or \r\n; the files are read in splits, twice. ``header`` marks the first
    record of each file. Empty records are left out. A record that goes over the edge of a split is
    put together by itself, so what one task holds is a split's batch or one record.
    """
    lines, folders = _lines(spark, path)
    states = store(split_states(lines.drop("folder"), separator), new_path(spark, "split-states"))
    # One row for each split: broadcast, so that the lines stay in their order.
    placed = lines.join(F.broadcast(states), ["file", "start"]).select("file", "start", "inside", "opener", "folder", "value")
    names = ["file", "start", "opener", "folder", "whole", "header", "record"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = None, [], 0
        own: list[bytes] = []
        for batch in batches:
            values = batch.column("value").cast(pa.binary()).to_pylist()
            inside, opener = (batch.column(c).to_pylist() for c in ("inside", "opener"))
            for split, place in _stretches(batch):
                if split != held:
                    if own:
                        rows.append(part(held, begun, folder, own))
                    held, state, own, folder = split, inside[place.start], [], batch.column("folder")[place.start].as_py()
                    # Lines before the first record belong to one that another split began.
                    begun, first = opener[place.start] if state else None, split[1] == 0
                for line in values[place]:
                    own.append(line)
                    state = ends_inside(line, state, separator.encode())
                    if state:
                        continue
                    if begun is not None:
                        rows.append(part(held, begun, folder, own))
                    else:
                        record = own[0] if len(own) == 1 else b"\n".join(own)
                        rows.append((*held, held[1], folder, True, first, record))
                        first = first and not record.strip(b"\r")
                    size += len(line)
                    own, begun = [], None
                    if len(rows) >= BATCH_ROWS or size > BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
        if own:
            rows.append(part(held, begun, folder, own))
        yield packed(rows)

    def part(split: tuple[int, int], begun: int | None, folder: str | None, lines: list[bytes]) -> tuple:
        return *split, split[1] if begun is None else begun, folder, False, False, b"\n".join(lines)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    cut = store(placed.mapInArrow(run, "file long, start long, opener long, folder string, whole boolean, header boolean, record binary")
                .withColumn("record", F.col("record").cast("string")), new_path(spark, "records"))
    parts = F.array_sort(F.collect_list(F.struct("start", "record")))
    joined = cut.where("NOT whole").groupBy("file", "opener").agg(
        F.array_join(F.transform(parts, lambda p: p.getField("record")), "\n").alias("record"), F.first("folder").alias("folder"))
    # The first record of a file that is longer than a split has no other in front of it.
    heads = cut.where("header AND whole").select("file").distinct().withColumn("headed", F.lit(True))
    joined = joined.join(heads, "file", "left").select(
        "record", ((F.col("opener") == 0) & F.col("headed").isNull()).alias("header"), "folder")
    both = cut.where("whole").select("record", "header", "folder").union(joined).withColumn(
        "record", F.regexp_replace("record", "\r$", "")).where("record <> ''")
    if len(folders):
        both = both.select("record", "header", F.from_json("folder", folders).alias("folder")).select("record", "header", "folder.*")
    return both.drop("folder")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def parse_records(records: DataFrame, schema: T.StructType, drop_malformed: bool = True, **options) -> DataFrame:
    """The records as columns of ``schema``, those that do not fit it left out or with nulls.

    ``options`` are those of the CSV reader. Columns that are partition folders are not in the records.
    """
    folders = set(records.columns) - {"record", "header"}
    own = T.StructType([*(f for f in schema if f.name not in folders), T.StructField(CORRUPT, T.StringType())])
    settings = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
    parsed = records.withColumn("_row", F.from_csv("record", _ddl(own), {k: str(v) for k, v in settings.items()}))
    if drop_malformed:
        parsed = parsed.where(F.col(f"_row.{CORRUPT}").isNull())
    return parsed.select(*[F.col(f.name).cast(f.dataType) if f.name in folders else F.col("_row").getField(f.name).alias(f.name)
                           for f in schema])
