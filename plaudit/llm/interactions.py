"""How filters interact: contingency tensors of their verdicts, contracted for every order and step."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm.common import texts
from plaudit.scratch import new_path, store

# Fixed values of the five filters: fewest words, least percent of distinct words, most percent of
# capitals, and the signs that no text may hold.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"

# The filters on the text alone; the fifth, E, needs the whole table.
TEXT_FILTERS, COPY_FILTER = "ABCD", "E"

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# What a selector takes along the axis of a filter: [passed, failed].
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: bytes) -> int:
    """Bit i is set if the text fails filter i of ``TEXT_FILTERS``."""
    words = text.split()
    chars = len(text.decode())
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * capitals > MAX_CAPITALS * chars) << 2
            | (len(text) > len(text.translate(None, SIGNS))) << 3)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, fails) of every row: bit i of ``fails`` is set if the row fails filter i of ABCDE.

    A null text is empty, a null part the empty string. E fails where a smaller key has the
    identical text; a null key is neither smaller nor larger than any, so it passes E, and rows
    that repeat key and text are judged alike. Texts are compared by MD5 and length. The smallest
    key of a text is joined back on text and key together, so a text that most rows share is
    spread over all tasks.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch)
            prints = [hashlib.md5(t).digest() + len(t).to_bytes(8, "big") for t in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("part"), pa.array(prints, pa.binary()),
                 pa.array([text_failures(t) for t in found], pa.int32())], ["key", "part", "print", "fails"])

    kind = rows.schema["key"].dataType.simpleString()
    marked = store(rows.mapInArrow(run, f"key {kind}, part string, print binary, fails int"),
                   new_path(docs.sparkSession, "filters"))
    first = marked.where("key IS NOT NULL").groupBy("print").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    keyed = marked.where("key IS NOT NULL").join(first, ["print", "key"], "left")
    copy = F.when(F.col("first"), 0).otherwise(1 << len(TEXT_FILTERS))
    judged = keyed.select("key", "part", (F.col("fails") + copy).alias("fails"))
    return judged.union(marked.where("key IS NULL").select("key", "part", "fails")).withColumnRenamed("key", key)


def count_cells(judged: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): documents, labelled good ones and toxic ones of every verdict.

    A document is good (toxic) if any of its label rows says so; a null key has no label. At most
    2^filters rows a part leave each task.
    """
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = judged.where(F.col(key).isNotNull()).join(marks, F.col(key) == F.col("_key"), "left").select(
        "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rest = judged.where(F.col(key).isNull()).select("part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return rows.union(rest).groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def selectors(filters: str) -> dict[str, np.ndarray]:
    """For each figure a 0/1 array [filter, order and step, passed or failed], orders by letter."""
    orders = list(permutations(range(len(filters))))
    shape = (len(filters), len(orders) * len(filters), 2)
    found = {name: np.empty(shape, np.int64) for name in ("kept", "removed", "failing", "alone")}
    for row, (order, step) in enumerate((order, step) for order in orders for step in range(len(filters))):
        own, before, upto = order[step], order[:step], order[:step + 1]
        for axis in range(len(filters)):
            found["kept"][axis, row] = PASS if axis in upto else ALL
            found["removed"][axis, row] = FAIL if axis == own else PASS if axis in before else ALL
            found["failing"][axis, row] = FAIL if axis == own else ALL
            found["alone"][axis, row] = FAIL if axis == own else PASS
    return found


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """[order and step, measure]: the tensor [measure, 2, 2, ...] with one selector on each axis."""
    axes = "abcdefgh"[:tensor.ndim - 1]
    return np.einsum(f"z{axes},{','.join('y' + a for a in axes)}->yz", tensor, *chosen, optimize="greedy")


def audit(cells: DataFrame, filters: str = TEXT_FILTERS + COPY_FILTER) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    ``cells`` holds (part, fails, n, good, toxic), where bit i of ``fails`` belongs to filter i.
    The counts of a part are reshaped to a 2 x 2 x ... tensor and contracted with pass, fail or
    all along each axis. ``shapley`` is what the step's filter removes, summed over all orders.
    A part is at most 2^filters rows, so no group is large; there are up to eight filters.
    """
    if not 0 < len(filters) <= 8:
        raise ValueError("one to eight filters")
    names = ["".join(filters[i] for i in order) for order in permutations(range(len(filters)))]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tensor = np.zeros((3, 1 << len(filters)), np.int64)
        tensor[:, part["fails"]] = part[["n", "good", "toxic"]].to_numpy(np.int64).T
        # Bit 0 is the last axis of the reshaped tensor.
        tensor = tensor.reshape(3, *[2] * len(filters)).transpose(0, *range(len(filters), 0, -1))
        chosen = selectors(filters)
        removed = contract(tensor, chosen["removed"])
        failing = contract(tensor[:1], chosen["failing"])[:, 0]
        steps = np.tile(np.arange(1, len(filters) + 1), len(names))
        own = np.array([filters.index(name[step]) for name in names for step in range(len(filters))])
        shapley = np.bincount(own, removed[:, 0], len(filters)).astype(np.int64)
        return pd.DataFrame({
            "part": part["part"].iloc[0], "filter_order": np.repeat(names, len(filters)), "step": steps.astype(np.int32),
            "kept": contract(tensor[:1], chosen["kept"])[:, 0], "removed": removed[:, 0], "redundant": failing - removed[:, 0],
            "unique_fails": contract(tensor[:1], chosen["alone"])[:, 0], "good_lost": removed[:, 1], "toxic_lost": removed[:, 2],
            "shapley": shapley[own]})

    figures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return cells.groupBy("part").applyInPandas(
        run, "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in figures))


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                    part: str = "lang") -> DataFrame:
    """The audit of the five filters A to E over ``docs``; an empty table has no part and no row."""
    return audit(count_cells(judge(docs, key, text, part), labels, key))
