"""Connected components of link tables: forests inside tasks, label exchange between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plaudit.scratch import store


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for every component of the links: (node, smallest node), roots left out.

    Labels fall to the smallest neighbour and then jump to their own label, until nothing changes.
    """
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[:len(left)], ends[len(left):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``links(a, b)`` reaches.

    Alternates two steps on a table of links child -> parent, each written under ``path`` so that
    a lost executor repeats one step at most. Every node points its larger neighbours to its
    smallest neighbour, then its smaller neighbours (and itself) to the smallest of those. Both
    keep the components; the table ends as stars after a number of rounds that grows with the
    logarithm of the longest chain. Neighbours are never gathered: the smallest one of each node
    is an aggregate, joined back, so a node with many neighbours can be split by the join.
    """
    spark = links.sparkSession
    table = store(links.where("a <> b").select(
        F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct(), f"{path}/links")
    step, before = 0, _state(table)
    while True:
        at = f"{path}/round-{step}"
        both = table.union(table.select("parent", "child")).toDF("node", "other")
        # The smallest neighbours are stored, so that the join has two plain sides and can be split.
        smallest = store(both.groupBy("node").agg(F.least("node", F.min("other")).alias("low")), f"{at}-smallest")
        large = store(both.where("other > node").join(smallest, "node")
                      .select(F.col("other").alias("child"), F.col("low").alias("parent")).distinct(), f"{at}-large")
        lowest = store(large.groupBy("child").agg(F.min("parent").alias("low")), f"{at}-lowest")
        small = large.join(lowest, "child").select(F.inline(F.array(
            F.struct(F.col("child"), F.col("low").alias("parent")),
            F.struct(F.col("parent").alias("child"), F.col("low").alias("parent")))))
        table = store(small.where("child <> parent").distinct(), f"{at}-small")
        now = _state(table)
        if now == before:
            break
        step, before = step + 1, now
    nodes = table.select(F.col("child").alias("node"), F.col("parent").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct()).toDF("node", "component")


def _state(table: DataFrame) -> tuple:
    """Equal for equal link tables."""
    return tuple(table.agg(F.count("*"), F.sum(F.hash("child", "parent").cast("long")),
                           F.sum(F.hash("parent", "child").cast("long"))).first())
