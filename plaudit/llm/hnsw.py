"""Embedding near-duplicates over hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm.components import components, forest
from plaudit.operators.numbering import dense_index
from plaudit.scratch import new_path, store

# Cosine from which two vectors are linked.
THRESHOLD = 0.98

# Vectors of one graph at about; links of a node above and on the ground level; beam while building.
SHARD_ROWS, LINKS, GROUND_LINKS, BUILD_BEAM = 6_000, 12, 24, 48

# First beam of a search, true links that an audit must have seen, recall to reach.
BEAM, AUDIT_LINKS, RECALL = 24, 400, 0.99

# Tasks that compare shards at most; beyond that a task takes several pairs.
MOST_TASKS = 50_000


class Graph:
    """A small-world graph over unit vectors; similarity is the dot product."""

    def __init__(self, vectors: np.ndarray, ground: np.ndarray | None = None, levels: list | None = None, entry: int = 0):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        self.ground = np.full((n, GROUND_LINKS), -1, np.int32) if ground is None else ground
        self.degree = (self.ground >= 0).sum(axis=1)
        self.levels: list[dict[int, list[int]]] = levels or []
        self.entry = entry

    @staticmethod
    def build(vectors: np.ndarray, seed: int = 3) -> Graph:
        """Insert the vectors in order; a node's top level is drawn from a seeded exponential."""
        graph = Graph(vectors)
        heights = (-np.log(np.random.default_rng(seed).random(len(vectors))) / math.log(LINKS)).astype(int)
        for node in range(len(vectors)):
            graph._insert(node, int(heights[node]))
        return graph

    def _neighbours(self, node: int, level: int):
        if level == 0:
            return self.ground[node, :self.degree[node]]
        return np.array(self.levels[level - 1].get(node, ()), np.int32)

    def _descend(self, query: np.ndarray, start: int, level: int) -> int:
        best = float(self.vectors[start] @ query)
        while True:
            near = self._neighbours(start, level)
            if not len(near):
                return start
            found = self.vectors[near] @ query
            at = int(found.argmax())
            if found[at] <= best:
                return start
            start, best = int(near[at]), float(found[at])

    def _beam(self, query: np.ndarray, start: int, level: int, width: int, floor: float = 2.0) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes met, and all those met that are at least ``floor`` similar.

        Nodes above the floor are always expanded, so the search floods a whole group of near
        copies, however large it is.
        """
        seen = np.zeros(len(self.vectors), bool)
        seen[start] = True
        first = float(self.vectors[start] @ query)
        waiting, kept, above = [(-first, start)], [(first, start)], []
        if first >= floor:
            above.append((first, start))
        while waiting:
            distance, node = heapq.heappop(waiting)
            if -distance < kept[0][0] and len(kept) >= width and -distance < floor:
                break
            near = self._neighbours(node, level)
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            found = self.vectors[near] @ query
            low = kept[0][0] if len(kept) >= width else -2.0
            take = np.nonzero((found > low) | (found >= floor))[0]
            for similarity, other in zip(found[take].tolist(), near[take].tolist()):
                heapq.heappush(waiting, (-similarity, other))
                heapq.heappush(kept, (similarity, other))
                if similarity >= floor:
                    above.append((similarity, other))
                if len(kept) > width:
                    heapq.heappop(kept)
        return above if floor <= 1.0 else kept

    def _insert(self, node: int, height: int) -> None:
        if node == 0:
            self.levels = [{0: []} for _ in range(height)]
            return
        query, at = self.vectors[node], self.entry
        for level in range(len(self.levels), height, -1):
            at = self._descend(query, at, level)
        for level in range(min(height, len(self.levels)), -1, -1):
            found = self._beam(query, at, level, BUILD_BEAM)
            chosen = self._select(found, LINKS)
            at = max(found)[1]
            if level == 0:
                self.ground[node, :len(chosen)] = chosen
                self.degree[node] = len(chosen)
                for other in chosen:
                    self._link_ground(other, node)
            else:
                links = self.levels[level - 1]
                links[node] = list(chosen)
                for other in chosen:
                    links[other].append(node)
                    if len(links[other]) > LINKS:
                        links[other] = self._select(self._scored(other, links[other]), LINKS)
        while len(self.levels) < height:
            self.levels.append({node: []})
            self.entry = node

    def _link_ground(self, node: int, new: int) -> None:
        if self.degree[node] < GROUND_LINKS:
            self.ground[node, self.degree[node]] = new
            self.degree[node] += 1
            return
        chosen = self._select(self._scored(node, [*self.ground[node].tolist(), new]), GROUND_LINKS)
        self.ground[node] = -1
        self.ground[node, :len(chosen)] = chosen
        self.degree[node] = len(chosen)

    def _scored(self, node: int, others: list[int]) -> list[tuple[float, int]]:
        return list(zip((self.vectors[others] @ self.vectors[node]).tolist(), others))

    def _select(self, found: list[tuple[float, int]], limit: int) -> list[int]:
        """Neighbours in different directions: one goes if it is nearer to a chosen one than to the node."""
        found = sorted(found, reverse=True)
        if len(found) <= limit // 2:
            return [node for _, node in found]
        nodes = [node for _, node in found]
        between = self.vectors[nodes] @ self.vectors[nodes].T
        chosen: list[int] = []
        rest = []
        for i, (similarity, _) in enumerate(found):
            if len(chosen) == limit:
                break
            if not chosen or between[i, chosen].max() <= similarity:
                chosen.append(i)
            else:
                rest.append(i)
        return [nodes[i] for i in chosen + rest[:limit - len(chosen)]]

    def search(self, query: np.ndarray, floor: float, width: int) -> list[int]:
        """Nodes at least ``floor`` similar to ``query`` that the search meets."""
        at = self.entry
        for level in range(len(self.levels), 0, -1):
            at = self._descend(query, at, level)
        # The beam finds the neighbourhood; from its best nodes the flood finds the whole group.
        near = self._beam(query, at, 0, width)
        best = max(near)[1]
        if float(self.vectors[best] @ query) < floor:
            return []
        flood = {node for _, node in self._beam(query, best, 0, width, floor)}
        return list(flood | {node for similarity, node in near if similarity >= floor})


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _audit(queries: np.ndarray, vectors: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Some queries and their true links, by brute force: as many as it takes to see ``AUDIT_LINKS`` links, or all.

    A query's match with itself, where both sides are the ``same`` vectors, is no link.
    """
    order = np.random.default_rng(len(queries)).permutation(len(queries))
    truth, seen = [], 0
    for i in range(0, len(order), 256):
        part = order[i:i + 256]
        links = queries[part] @ vectors.T >= threshold
        if same:
            links[np.arange(len(part)), part] = False
        truth.append(links)
        seen += int(links.sum())
        if seen >= AUDIT_LINKS:
            break
    truth = np.concatenate(truth) if truth else np.empty((0, len(vectors)), bool)
    return order[:len(truth)], truth


def _matches(graph: Graph, queries: np.ndarray, vectors: np.ndarray, threshold: float, same: bool = False) -> np.ndarray:
    """Verified links [query, vector]. The beam doubles until an audit passes.

    If the search met less than ``RECALL`` of the true links of the audited queries, all queries are
    searched anew with a beam twice as wide. Where links are few, all queries are audited, so none
    is lost; the links that an audit finds are kept. At the width of the shard the search is
    exhaustive.
    """
    floor = threshold - 1e-4  # single precision finds, double precision decides
    single = queries.astype(np.float32)
    audited, truth = _audit(queries, vectors, threshold, same)
    width = BEAM
    while True:
        found = np.zeros((len(queries), len(vectors)), bool)
        if width >= len(vectors):
            for i in range(0, len(queries), 512):
                found[i:i + 512] = queries[i:i + 512] @ vectors.T >= floor
        else:
            for i, query in enumerate(single):
                found[i, graph.search(query, floor, width)] = True
        if width >= len(vectors) or (found[audited] & truth).sum() >= RECALL * truth.sum():
            break
        width *= 2
    found[audited] |= truth
    at, to = np.nonzero(found)
    for i in range(0, len(at), 200_000):
        a, b = at[i:i + 200_000], to[i:i + 200_000]
        found[a, b] = np.einsum("ij,ij->i", queries[a], vectors[b]) >= threshold
    return found


def _pack(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows).tobytes()


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node")
    vectors = _unit(np.array(rows["vector"].tolist(), np.float64))
    graph = Graph.build(vectors)
    upper = [(level, node, other) for level, links in enumerate(graph.levels) for node, near in links.items()
             for other in [-1, *near]]
    return pd.DataFrame([{
        **{name: rows[name].iloc[0] for name in ("label", "width", "shard", "shards")},
        "nodes": _pack(rows["node"].to_numpy(np.int64)), "copies": _pack(rows["copies"].to_numpy(np.int64)),
        "vectors": _pack(vectors), "ground": _pack(graph.ground),
        "upper": _pack(np.array(upper, np.int32).reshape(-1, 3)), "entry": graph.entry}])


_SHARD = ("label int, width int, shard int, shards int, nodes binary, copies binary, vectors binary, "
          "ground binary, upper binary, entry int")


def _load(row: dict, side: str):
    nodes = np.frombuffer(row[f"{side}_nodes"], np.int64)
    copies = np.frombuffer(row[f"{side}_copies"], np.int64)
    vectors = np.frombuffer(row[f"{side}_vectors"], np.float64).reshape(len(nodes), -1)
    levels: list[dict[int, list[int]]] = []
    for level, node, other in np.frombuffer(row[f"{side}_upper"], np.int32).reshape(-1, 3).tolist():
        while len(levels) <= level:
            levels.append({})
        near = levels[level].setdefault(node, [])
        if other >= 0:
            near.append(other)
    ground = np.frombuffer(row[f"{side}_ground"], np.int32).reshape(len(nodes), -1)
    return nodes, copies, vectors, Graph(vectors, ground, levels, row[f"{side}_entry"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each pair of shards: (node, links, other) rows, the links of each node and a spanning forest.

    Both shards query each other's graph; a link that either search meets counts. The pair's links
    are one table of bits of the size of the two shards, so a group of copies never becomes pairs.
    """
    for batch in batches:
        for row in batch.to_pylist():
            nodes, copies, vectors, graph = _load(row, "a")
            if row["a_shard"] == row["b_shard"]:
                others, other_copies = nodes, copies
                found = _matches(graph, vectors, vectors, threshold, same=True)
                found |= found.T
                np.fill_diagonal(found, False)
                links = [(nodes, found @ copies)]
            else:
                others, other_copies, more, second = _load(row, "b")
                found = _matches(second, vectors, more, threshold)
                found |= _matches(graph, more, vectors, threshold).T
                links = [(nodes, found @ other_copies), (others, copies @ found)]
            for node, count in links:
                met = count > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[met]), pa.array(count[met].astype(np.int64)), pa.nulls(int(met.sum()), pa.int64())],
                    ["node", "links", "other"])
            for i in range(0, len(found), 256):
                a, b = np.nonzero(found[i:i + 256])
                if len(a):
                    child, root = forest(nodes[a + i], others[b])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(child), pa.nulls(len(child), pa.int64()), pa.array(root)], ["node", "links", "other"])


def near_duplicates(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``embeddings``.

    Vectors are compared when their labels are equal and not null, by cosine in double precision.
    Equal vectors of one label are one node with a number of copies. The nodes of a label are dealt
    by hash into shards of about ``shard_rows``, each shard is a graph that is stored, and the
    nodes of every shard query every shard of the label, so a label with any share of the rows is
    split over many tasks. Vectors that are null, empty, zero or hold nulls or values that are not
    finite, and rows without a label, link with nothing. ``kept`` is true for the smallest key of a
    component. Rows that repeat a key count as vectors of their own; a null key links like any
    other, but a component is named by a key that is not null, if there is one.
    """
    path = new_path(embeddings.sparkSession, "hnsw")
    doubles = F.col("_v").cast("array<double>")
    rows = embeddings.select(F.col(key).alias("key"), F.col(vector).alias("_v"), F.col(label).cast("int").alias("label"))
    sound = (F.col("label").isNotNull() & (F.size(F.coalesce("_v", F.array().cast("array<double>"))) > 0)
             & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists(doubles, lambda x: x != 0))
    rows = store(rows.select("key", "label", F.when(sound, doubles).alias("vector")).withColumn(
        "class", F.when(F.col("vector").isNotNull(), F.sha2(F.to_json(F.struct("label", "vector")), 256))), f"{path}/rows")
    classes = rows.where("class IS NOT NULL").groupBy("class", "label").agg(
        F.min("key").alias("least"), F.count("*").alias("copies"), F.max("vector").alias("vector"))
    nodes = store(dense_index(classes.withColumn("width", F.size("vector")), ["class"], "node"), f"{path}/nodes")
    sizes = store(nodes.groupBy("label", "width").agg(
        F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), f"{path}/sizes")
    dealt = nodes.join(sizes, ["label", "width"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    total, pairs = sizes.agg(F.sum("shards"), F.sum(F.expr("shards * (shards + 1L) div 2"))).first()
    where = ["label", "width", "shard"]
    # Ranges, so that each shard comes to a task of its own; the plan's own sizes would join small ones.
    dealt = dealt.select(*where, "shards", "node", "copies", "vector").repartitionByRange(max(1, total or 0), *where)
    shards = store(dealt.groupBy(*where).applyInPandas(_build_shard, _SHARD), f"{path}/shards")
    parts = ["nodes", "copies", "vectors", "ground", "upper", "entry"]
    first = shards.select("label", "width", F.col("shard").alias("a_shard"), *[F.col(c).alias(f"a_{c}") for c in parts],
                          F.explode(F.sequence("shard", F.col("shards") - 1)).alias("b_shard"))
    second = shards.select("label", "width", F.col("shard").alias("b_shard"), *[F.col(c).alias(f"b_{c}") for c in parts])
    both = first.join(second, ["label", "width", "b_shard"]).repartition(min(MOST_TASKS, max(1, pairs or 0)), "label", "width", "a_shard", "b_shard")
    met = store(both.mapInArrow(lambda batches: _compare(batches, threshold), "node long, links long, other long"), f"{path}/met")

    found = components(met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), f"{path}/components")
    counts = met.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    member = store(nodes.select("class", "node", "least", "copies").join(counts, "node", "left").join(found, "node", "left")
                   .withColumn("root", F.coalesce("component", "node")), f"{path}/members")
    roots = store(member.groupBy("root").agg(F.min("least").alias("component_id")), f"{path}/roots")
    named = store(member.join(roots, "root").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), f"{path}/named")
    linked = rows.where("class IS NOT NULL").join(named, "class").select("key", "n_links", "component_id")
    alone = rows.where("class IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.union(alone).select(F.col("key").alias(key), "n_links", "component_id",
                                      F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
