"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaudit.llm.common import SPACES
from plaudit.scratch import new_path, release, store

# A key of at least this many code points, in at least this many documents, is a repeated line.
MIN_CHARS, MIN_DOCS = 40, 5

# Batches that a whole table is fed in, and runs of one level that are compacted into the next.
BATCHES, FAN_IN = 4, 2

_NO_KEY = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_lines(text: str) -> Column:
    r"""The text cut at every \n; a null or empty text is one empty line."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


class LineRuns:
    """Levelled sorted runs of (hash, docs, last): documents that hold a line, and the largest of them.

    A run is a stored table, sorted by hash inside its files. Each batch of documents is
    merge-anti-joined with the runs, which tells its new lines from known ones, and then adds a
    run of its own. When a level holds ``fan_in`` runs they are compacted into one run of the
    next level, so a hash is rewritten once per level and the runs stay few.
    """

    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN) -> None:
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.levels: list[list[DataFrame]] = []
        self.written = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def admit(self, batch: DataFrame) -> DataFrame:
        """Add the distinct (hash, key) rows of a batch; returns the (hash, last) that are new.

        A line that is new belongs to the batch's largest key that holds it.
        """
        own = self._write(batch.groupBy("hash").agg(
            F.count("*").alias("docs"), F.max("key").alias("last")))
        new = own.select("hash", "last")
        for run in self.runs():
            new = new.join(run.select("hash"), "hash", "left_anti")
        new = store(new, f"{self.path}/new-{self.written}")
        self._place(0, own)
        return new

    def totals(self) -> DataFrame:
        """(hash, docs, last) over all runs."""
        return self._merged(self.runs())

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.union(run)
        return rows.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def _write(self, run: DataFrame) -> DataFrame:
        self.written += 1
        return store(run.sortWithinPartitions("hash"), f"{self.path}/run-{self.written}")

    def _place(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._place(level + 1, self._write(self._merged(full)))


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    # Rows are told apart by key and text, so a repeated key cannot mix up the lines of two texts.
    # A null key counts as the smallest one. Repeated rows have one print, so their lines are a set.
    return docs.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY))).withColumn(
        "_print", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN,
) -> DataFrame:
    """(_key, _print, _drop): 0-based numbers of the lines that each document loses.

    Lines whose key has ``min_chars`` code points and is held by ``min_docs`` documents go,
    except in the document with the largest key. Batches are fed from the largest keys down, so
    the batch that brings a line first holds that document; what a batch does not bring first is
    a repeat, and it goes if the runs count enough documents in the end. Keys are compared by
    MD5.
    """
    spark = docs.sparkSession
    path = new_path(spark, "lines")
    rows = docs.select(F.col(key).alias("_of"), F.col(text).alias("_text"))
    lines = _marked(rows, "_of", "_text").select(
        "_key", "_print", F.posexplode(split_lines("_text")).alias("line", "text"))
    lines = lines.where(F.char_length("text") >= min_chars).withColumn("text", line_key(F.col("text")))
    lines = lines.where(F.char_length("text") >= min_chars)
    met = store(lines.groupBy(F.unhex(F.md5("text")).alias("hash"), F.col("_key").alias("key")).agg(
        F.collect_list(F.struct("_print", "line")).alias("places")), f"{path}/met")

    bounds = met.approxQuantile("key", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted(set(map(int, bounds)), reverse=True), None]
    store_runs = LineRuns(spark, path, fan_in)
    repeats = None
    for high, low in zip(bounds[:-1], bounds[1:]):
        batch = met
        if high is not None:
            batch = batch.where(F.col("key") < high)
        if low is not None:
            batch = batch.where(F.col("key") >= low)
        new = store_runs.admit(batch.select("hash", "key"))
        known = batch.join(new.withColumnRenamed("last", "key"), ["hash", "key"], "left_anti")
        repeats = known if repeats is None else repeats.union(known)
    often = store(store_runs.totals().where(F.col("docs") >= min_docs).select("hash"), f"{path}/often")
    places = repeats.join(often, "hash").select("key", F.inline("places"))
    drops = store(places.groupBy(F.col("key").alias("_key"), "_print").agg(
        F.collect_set("line").alias("_drop")), new_path(spark, "drops"))
    release(spark, path)
    return drops


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    r"""``docs`` with the repeated lines taken out of ``text``, and with ``n_lines`` and ``n_dropped``.

    ``n_lines`` counts the lines before dropping. The lines that stay are joined by \n; a null
    text becomes the empty text. Keys are integers: rows with the same key count as one document,
    and so do all rows without a key, which is the smallest. Every row, repeated ones too, loses
    its own lines. Columns of ``docs`` of the two new names are replaced, all others are kept.
    """
    drops = repeated_lines(docs, key, text, **options)
    rows = _marked(docs.select(F.struct("*").alias("_row"), F.col(key).alias("_of"), F.col(text).alias("_text")), "_of", "_text")
    # Merged at every size, so that what a small table shuffles tells what a large one will.
    joined = rows.join(drops.hint("merge"), ["_key", "_print"], "left").withColumns({
        "_lines": split_lines("_text"), "_drop": F.coalesce("_drop", F.array().cast("array<int>"))})
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    rest = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    whole = F.when(F.size("_drop") == 0, F.coalesce("_text", F.lit(""))).otherwise(rest)
    columns = [whole.alias(c) if c == text else F.col("_row").getField(c).alias(c)
               for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*columns, F.size("_lines").cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_dropped"))
