"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.llm.common import SPACE_CLASS, row_print
from plaudit.operators.numbering import dense_index
from plaudit.scratch import new_path, store

# Fixed values of the query: weights of the sources in order, size of the mix, most epochs.
WEIGHTS, SHARE, EPOCHS = (3.0, 1.0, 2.0), 1.5, 2.0

# Seed of the fractional repetitions, and hash buckets in which a source is cut.
SEED, BUCKETS = 13, 4096


def word_count(text: str) -> Column:
    """Number of words of a text, 0 for null."""
    words = F.regexp_count(F.col(text), F.lit(SPACE_CLASS.replace("[", "[^", 1) + "+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def weigh_in_turn(sources: DataFrame, weights: Sequence[float], source: str = "source") -> DataFrame:
    """``sources`` with ``weight``: the weights in turn over the sources by code point, null last.

    The place of a source comes from a range-partitioned running number.
    """
    order = F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))
    placed = dense_index(sources.withColumn("_order", order), ["_order"], "_place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_place", F.lit(len(weights))).cast("int"))
    return placed.withColumn("weight", weight).drop("_order", "_place")


def fill(sources: DataFrame, total: float, epochs: float, path: str) -> DataFrame:
    """``sources(size, weight)`` with ``target``: ``total`` shared by weight, none above epochs * size.

    Sources above their cap are clamped and what is left is shared among the others, until all are
    feasible. Each round is two sums over the sources; only these reach the driver. Sources of
    weight 0 get nothing. If all caps together are below the total, every source is at its cap.
    """
    level = store(sources.withColumns({"cap": F.col("size") * F.lit(float(epochs)), "full": F.lit(False)}), f"{path}/level-0")
    step = 0
    while True:
        sums = level.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)),
                         F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)), F.count_if("full")).first()
        taken, weight, before = sums[0] or 0.0, sums[1] or 0.0, sums[2]
        share = max(0.0, total - taken) / weight if weight > 0 else 0.0
        open_target = F.col("weight") * F.lit(share)
        step += 1
        level = store(level.withColumn("full", F.col("full") | (open_target > F.col("cap"))), f"{path}/level-{step}")
        if level.where("full").count() == before:
            return level.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(open_target)).drop("cap", "full")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS,
        seed: int = SEED) -> DataFrame:
    """(key, size, source_size, target, copies, taken) of every row of ``docs``.

    Each source repeats all its documents as often as its target holds its whole size, and some
    of them once more. Those come in the order of a seeded hash until the rest of the target is
    reached; the document at the edge is taken if that comes nearer. The order is found in two
    steps, so no source meets in one task: sizes of hash buckets first, then the documents of the
    one bucket at the edge. Null is a source of its own; documents without words take nothing.
    The hash is of key and text, so rows with null or repeated keys are spread like others, and
    rows that repeat both can stand for each other: reruns agree.
    """
    path = new_path(docs.sparkSession, "mix")
    sized = store(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
                          F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text)).alias("hash")), f"{path}/sized")
    bucket = F.pmod("hash", F.lit(BUCKETS))
    sums = store(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), f"{path}/buckets")
    sources = store(sums.groupBy("source").agg(F.sum("size").alias("size")), f"{path}/sources")
    total = sources.agg(F.sum("size")).first()[0] or 0
    filled = fill(weigh_in_turn(sources, weights), share * total, epochs, path)
    repeats = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    plan = store(filled.select(
        F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", repeats.cast("long").alias("whole"),
        (F.col("target") - repeats * F.col("size")).alias("rest")), f"{path}/plan")

    # The bucket in which the rest of each source's target runs out.
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    edges = edges.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
    edges = store(edges.select("source", F.col("bucket").alias("edge"), "before").groupBy("source").agg(
        F.max_by("edge", "edge").alias("edge"), F.max_by("before", "edge").alias("before")), f"{path}/edges")
    plan = store(plan.join(edges, F.col("_source").eqNullSafe(F.col("source")), "left").drop("source"), f"{path}/edged")

    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("bucket", bucket)
    inside = Window.partitionBy("_source").orderBy("hash", "key").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where(F.col("bucket") == F.col("edge")).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at_edge = at_edge.withColumn("more", F.col("start") + F.col("size") / 2 <= F.col("rest"))
    others = rows.where("edge IS NULL OR bucket <> edge").withColumn(
        "start", F.lit(None).cast("long")).withColumn("more", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more").cast("long")).otherwise(0)
    return others.unionByName(at_edge).withColumn("copies", copies).select(
        F.col("key").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` repeated as often as the mix takes them; documents that it does not take are left out.

    Rows are mixed one by one, named by key and text, so null and repeated keys lose nothing;
    rows that repeat both, and differ in other columns alone, come as the first of them. Other
    columns stay as they are, whatever their names.
    """
    whole = docs.select(F.struct("*").alias("whole"), row_print(key, text).alias("print"), F.col(text).alias("text"), F.col(source).alias("source"))
    taken = mix(whole, "print", "text", "source", **options).groupBy("print").agg(F.sum("copies").alias("copies")).where("copies > 0")
    first = whole.groupBy("print").agg(F.min_by("whole", F.xxhash64("whole")).alias("whole"))
    return first.join(taken, "print").select("whole", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("whole.*")
