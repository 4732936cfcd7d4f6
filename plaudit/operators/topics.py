"""Topic models of the positive and the negative reviews, with the topic-term weights as a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from plaudit.functions import tokens as tok
from plaudit.operators.words import rank_by_count
from plaudit.scratch import new_path, release, store

# Topics, words shown per topic and sweeps over the corpus.
TOPICS, TOPIC_WORDS, SWEEPS = 5, 5, 20

# Words of the documents that make up one block, about: what one task holds at a time. Small corpora have
# smaller blocks, down to the second number, so that all cores have some.
BLOCK_WORDS, LEAST_BLOCK_WORDS = 3_000_000, 200_000

# Words of the corpus for each part of the vocabulary: a part adds up the numbers of at most so many words.
PART_WORDS = 2_000_000

# Entries of documents whose topic shares are found together.
STRETCH = 30_000

# Most rounds for the topic shares of the documents of a block, and the mean change that ends them.
ROUNDS, CHANGE = 50, 1e-3


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log gamma function for positive numbers: six steps up, then the series."""
    high = x + 6.0
    square = 1.0 / (high * high)
    series = square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return np.log(high) - 0.5 / high - series - sum(1.0 / (x + i) for i in range(6))


def trigamma(x: np.ndarray) -> np.ndarray:
    high = x + 6.0
    square = 1.0 / (high * high)
    series = (1 + square * (1 / 6 - square * (1 / 30 - square * (1 / 42 - square / 30)))) / high + 0.5 * square
    return series + sum(1.0 / (x + i) ** 2 for i in range(6))


@dataclass
class TopicModel:
    """``table(class, term, w0, w1, ...)``: the variational weight of every term in every topic.

    Only one number a class and topic is on the driver: the sum of the weights and the document
    prior. ``documents`` has, for each sweep, the number of documents of each class that it saw.
    """
    by: str
    k: int
    table: DataFrame
    totals: dict[str, np.ndarray]
    priors: dict[str, np.ndarray]
    documents: list[dict[str, int]] = field(default_factory=list)

    def weights(self) -> DataFrame:
        """(class, topic, term, weight): the share of every term in every topic of its class."""
        share = F.lit(None).cast("array<double>")
        for name, totals in self.totals.items():
            share = F.when(F.col(self.by) == name, F.array(*[F.col(f"w{i}") / F.lit(float(t)) for i, t in enumerate(totals)])).otherwise(share)
        return self.table.select(self.by, "term", F.posexplode(share).alias("topic", "weight")).select(
            self.by, "topic", "term", "weight")

    def topics(self, words: int) -> DataFrame:
        """(class, topic, rank, term, weight): the heaviest terms of each topic; ties go by term.

        Ranked in hash buckets of the terms first, so no task sees a whole vocabulary.
        """
        ranked = rank_by_count(self.weights().withColumnRenamed("weight", "n"), "term", words, self.by, "topic")
        return ranked.select(self.by, "topic", "rank", "term", F.col("n").alias("weight"))

    def document_priors(self) -> DataFrame:
        """(class, topic, doc_prior): the learned prior weight of each topic."""
        rows = [(name, i, float(a)) for name, prior in self.priors.items() for i, a in enumerate(prior)]
        return self.table.sparkSession.createDataFrame(rows, f"`{self.by}` STRING, topic INT, doc_prior DOUBLE")


def _block_words(total: int, cores: int) -> int:
    """Words of a block: fewer blocks share more terms, but there are enough of them for all cores."""
    return min(BLOCK_WORDS, max(LEAST_BLOCK_WORDS, total // (3 * cores)))


def _blocks(docs: DataFrame, tokens: str, by: str, count: int, parts: int) -> DataFrame:
    """(class, block, part, doc, place, n, terms): documents dealt into blocks by hash, as packed arrays.

    The row with part -1 has one entry for each document and term of the block. The other rows have
    the block's distinct terms that fall into a part by their hash; ``place`` is a term's place in all
    of these, one part after the other. A document without words has nothing to learn from and is in no block.
    """
    dealt = docs.select(by, F.pmod(F.xxhash64(tokens), F.lit(count)).alias("block"),
                        tok.bag(F.col(tokens)).alias("bag")).where("size(bag) > 0")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        bags = rows.column("bag").chunk(0)
        entries = bags.flatten()
        named = entries.field("term").dictionary_encode()
        terms = named.dictionary.to_pylist()
        part = np.array([crc32(t.encode()) % parts for t in terms], np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(terms), np.int32)
        place[order] = np.arange(len(terms), dtype=np.int32)
        sizes = np.diff(bags.offsets.to_numpy())
        doc = np.repeat(np.arange(len(bags), dtype=np.int32), sizes)
        packed = [doc, place[named.indices.to_numpy()], entries.field("n").to_numpy().astype(np.int32)]
        used, starts = np.unique(part[order], return_index=True)
        ordered = named.dictionary.take(pa.array(order))
        offsets = np.concatenate([[0, 0], starts[1:], [len(terms)]]).astype(np.int32)
        height = len(used) + 1
        return pa.table({
            by: pa.array([rows.column(by)[0].as_py()] * height, pa.string()),
            "block": pa.array([rows.column("block")[0].as_py()] * height, pa.int64()),
            "part": pa.array([-1, *used.tolist()], pa.int64()),
            **{name: pa.array([a.tobytes()] + [None] * len(used), pa.binary()) for name, a in zip(("doc", "place", "n"), packed)},
            "terms": pa.ListArray.from_arrays(pa.array(offsets), ordered)})

    return dealt.groupBy(by, "block").applyInArrow(
        pack, f"`{by}` string, block long, part long, doc binary, place binary, n binary, terms array<string>")


def _vocabulary(blocks: DataFrame, by: str) -> DataFrame:
    """(class, block, part, index, terms): every block's terms as numbers in their part of the vocabulary.

    The terms of a part are in the row with block -1.
    """
    def number(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = rows.column("terms").chunk(0)
        named = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        cuts = np.split(named.indices.to_numpy().astype(np.int32), np.cumsum(sizes)[:-1])
        height = len(rows) + 1
        return pa.table({
            by: pa.array([rows.column(by)[0].as_py()] * height, pa.string()),
            "block": pa.concat_arrays([rows.column("block").chunk(0), pa.array([-1], pa.int64())]),
            "part": pa.array([rows.column("part")[0].as_py()] * height, pa.int64()),
            "index": pa.array([c.tobytes() for c in cuts] + [None], pa.binary()),
            "terms": pa.array([None] * len(rows) + [named.dictionary.to_pylist()], pa.list_(pa.string()))})

    return blocks.where("part >= 0").select(by, "block", "part", "terms").groupBy(by, "part").applyInArrow(
        number, f"`{by}` string, block long, part long, index binary, terms array<string>")


def expect(doc: np.ndarray, place: np.ndarray, n: np.ndarray, weights: np.ndarray, prior: np.ndarray):
    """Topic shares of the documents of a block under fixed term weights.

    ``doc`` rises; ``weights`` are exp(E[log beta]) of the block's terms. Returns the expected
    uses of each term in each topic, and the sum over the documents of E[log theta].
    """
    uses, log_sums, gamma = expect_from(doc, place, n, weights, prior)
    return uses, log_sums, gamma.shape[1]


def expect_from(doc: np.ndarray, place: np.ndarray, n: np.ndarray, weights: np.ndarray, prior: np.ndarray,
                gamma: np.ndarray | None = None):
    """As ``expect``, from the topic shares ``gamma`` (topics, documents) of a sweep before, if given.

    Returns the uses, the sums and the new ``gamma``. Stretches of whole documents are taken in turn,
    as many as a processor's cache holds; the rounds of each go on until its own mean change is small.
    """
    starts = np.nonzero(np.diff(doc, prepend=-1))[0]
    ends = np.append(starts[1:], len(doc))
    found = np.empty((len(prior), len(starts)))
    uses, log_sums = np.zeros((len(prior), len(weights))), np.zeros(len(prior))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STRETCH, side="right")))
        low, high = starts[first], ends[last - 1]
        own, logs, found[:, first:last] = _rounds(
            starts[first:last] - low, ends[first:last] - starts[first:last], n[low:high], weights[place[low:high]], prior,
            None if gamma is None else gamma[:, first:last])
        for i, use in enumerate(own):
            uses[i] += np.bincount(place[low:high], use, len(weights))
        log_sums += logs
        first = last
    return uses.T, log_sums, found


def _rounds(starts: np.ndarray, sizes: np.ndarray, n: np.ndarray, weights: np.ndarray, prior: np.ndarray, gamma: np.ndarray | None):
    # One row a topic: sums over the entries of a document are then runs of one array.
    own = np.ascontiguousarray(weights.T)

    def shared(theta: np.ndarray) -> np.ndarray:
        """Count of each entry over its sum over the topics."""
        return n / (sum(np.repeat(t, sizes) * w for t, w in zip(theta, own)) + 1e-100)

    def log_shares(gamma: np.ndarray) -> np.ndarray:
        return digamma(gamma) - digamma(gamma.sum(axis=0))

    if gamma is None:
        gamma = prior[:, None] + np.add.reduceat(n, starts) / len(prior)
    for _ in range(ROUNDS):
        theta = np.exp(log_shares(gamma))
        ratio = shared(theta)
        new = prior[:, None] + theta * np.stack([np.add.reduceat(ratio * w, starts) for w in own])
        change = np.abs(new - gamma).mean()
        gamma = new
        if change < CHANGE:
            break
    log_theta = log_shares(gamma)
    theta = np.exp(log_theta)
    ratio = shared(theta)
    return [np.repeat(t, sizes) * w * ratio for t, w in zip(theta, own)], log_theta.sum(axis=1), gamma


def new_prior(prior: np.ndarray, mean_log: np.ndarray, documents: int) -> np.ndarray:
    """A Newton step of the asymmetric prior towards the mean of E[log theta], shortened until all are positive."""
    gradient = documents * (digamma(prior.sum()) - digamma(prior) + mean_log)
    curve = -documents * trigamma(prior)
    shared = (gradient / curve).sum() / (1.0 / (documents * trigamma(prior.sum())) + (1.0 / curve).sum())
    step = -(gradient - shared) / curve
    while np.any(prior + step <= 1e-3 * prior):
        step = step / 2
    return prior + step


def fit_topics(
    docs: DataFrame, tokens: str = "tokens", by: str = "polarity", classes: Sequence[str] = ("pos", "neg"),
    k: int = TOPICS, sweeps: int = SWEEPS, seed: int = 7, block_words: int | None = None,
) -> TopicModel:
    """Latent topics of each class by variational sweeps over all documents, with a learned document prior.

    The vocabulary is dealt into parts. In a sweep every block of documents gets the weights of its
    own terms from the parts, finds the topic shares of every document in turn, going on from those
    of the sweep before, and gives out the expected uses of its terms, which every part adds up: no
    task and not the driver holds all terms. A row is the numbers of one block and one part, so
    what is shuffled is arrays and not terms. Every document is in every sweep. A sweep is written
    before the next, so a lost executor repeats one sweep at most; the one before it is deleted.
    Pass stored tokens. Rows of other classes and rows without words take no part; a class without
    words has no topic.
    """
    spark = docs.sparkSession
    path = new_path(spark, "topics")
    docs = docs.where(F.col(by).isin(list(classes)))
    cores = spark.sparkContext.defaultParallelism
    total = docs.agg(F.sum(F.size(tokens))).first()[0] or 0
    count = -(-total // (block_words or _block_words(total, cores))) or 1
    parts = max(2 * cores, -(-total // PART_WORDS))
    blocks = store(_blocks(docs, tokens, by, count, parts), f"{path}/blocks")
    vocabulary = store(_vocabulary(blocks, by), f"{path}/vocabulary")
    names = [f"w{i}" for i in range(k)]
    prior_weight = 1.0 / k
    sums = ", ".join(f"{n} double" for n in names)

    # Hashes of term and topic give every topic its own start.
    def start(topic: int) -> Column:
        return F.transform("terms", lambda t: F.lit(prior_weight) + F.pmod(F.xxhash64(t, F.lit(seed), F.lit(topic)), F.lit(1 << 20)) / F.lit(float(1 << 20)))

    starts = [start(i).alias(name) for i, name in enumerate(names)]

    def begin(rows: pa.Table) -> pa.Table:
        """The start of a part, dealt out like its weights after a sweep."""
        rows = rows.combine_chunks()
        whole = [i for i, b in enumerate(rows.column("block").to_pylist()) if b < 0][0]
        weights = np.stack([rows.column(c)[whole].values.to_numpy() for c in names])
        return deal(rows, weights)

    def deal(rows: pa.Table, weights: np.ndarray) -> pa.Table:
        asked = rows.filter(pc.greater_equal(rows.column("block"), 0))
        index = asked.column("index").to_pylist()
        height = len(asked) + 1
        return pa.table({
            by: pa.array([rows.column(by)[0].as_py()] * height, pa.string()),
            "block": pa.array([*asked.column("block").to_pylist(), -1], pa.int64()),
            "part": pa.array([rows.column("part")[0].as_py()] * height, pa.int64()),
            "index": pa.array([*index, None], pa.binary()),
            "value": pa.array([*[weights[:, np.frombuffer(i, np.int32)].tobytes() for i in index], weights.tobytes()], pa.binary()),
            **{c: pa.array([None] * len(asked) + [float(weights[i].sum())], pa.float64()) for i, c in enumerate(names)},
            "documents": pa.nulls(height, pa.int64())})

    def add(rows: pa.Table) -> pa.Table:
        """The new weights of a part, dealt out to the blocks that use them."""
        if rows.column("part")[0].as_py() < 0:
            return rows
        uses = [(np.frombuffer(i, np.int32), np.frombuffer(v).reshape(k, -1))
                for i, v in zip(rows.column("index").to_pylist(), rows.column("value").to_pylist())]
        weights = np.full((k, 1 + max(int(i.max()) for i, _ in uses)), prior_weight)
        for index, value in uses:
            weights[:, index] += value
        return deal(rows, weights)

    # Rows with a block and a part have the weights of the block's terms; without a block (-1) those of the
    # whole part and their sums; without a part (-1) the topic shares and sums of the block's documents.
    schema = f"`{by}` string, block long, part long, index binary, value binary, {sums}, documents long"
    first = vocabulary.select(by, "block", "part", "index", *starts).groupBy(by, "part").applyInArrow(begin, schema)
    model = TopicModel(by, k, store(first, f"{path}/sweep-0"), {}, {})

    def totals_of(table: DataFrame) -> list:
        found = table.where("block < 0 OR part < 0").groupBy(by, (F.col("part") < 0).alias("over"))
        return found.agg(*[F.sum(c).alias(c) for c in (*names, "documents")]).collect()

    model.totals = {r[by]: np.array([r[c] for c in names]) for r in totals_of(model.table)}
    model.priors = {name: np.full(k, 1.0 / k) for name in model.totals}
    entries = blocks.where("part < 0").select(by, "block", "doc", "place", "n")

    for sweep in range(1, sweeps + 1):
        totals, priors = model.totals, model.priors

        def run(rows: pa.Table, given: pa.Table) -> pa.Table:
            name, block = rows.column(by)[0].as_py(), rows.column("block")[0].as_py()
            doc, place, n = (np.frombuffer(rows.column(c)[0].as_py(), np.int32) for c in ("doc", "place", "n"))
            given = given.sort_by("part")
            held, values = given.column("part").to_pylist(), [np.frombuffer(v).reshape(k, -1) for v in given.column("value").to_pylist()]
            gamma = values.pop(0) if held[0] < 0 else None
            weights = np.concatenate(values, axis=1).T
            uses, logs, gamma = expect_from(
                doc, place, n.astype(float), np.exp(digamma(weights) - digamma(totals[name])), priors[name], gamma)
            cuts = np.split(uses.T, np.cumsum([v.shape[1] for v in values])[:-1], axis=1)
            used = given.slice(len(held) - len(values))
            height = len(values) + 1
            return pa.table({
                by: pa.array([name] * height, pa.string()),
                "block": pa.array([block] * height, pa.int64()),
                "part": pa.array([-1, *used.column("part").to_pylist()], pa.int64()),
                "index": pa.array([None, *used.column("index").to_pylist()], pa.binary()),
                "value": pa.array([gamma.tobytes(), *[c.tobytes() for c in cuts]], pa.binary()),
                **{c: pa.array([logs[i]] + [None] * len(values), pa.float64()) for i, c in enumerate(names)},
                "documents": pa.array([gamma.shape[1]] + [None] * len(values), pa.int64())})

        given = model.table.where("block >= 0").select(by, "block", "part", "index", "value")
        met = entries.groupBy(by, "block").cogroup(given.groupBy(by, "block")).applyInArrow(run, schema)
        # The rows of the documents are groups of their own, by block, and pass as they are.
        own = F.when(F.col("part") < 0, F.col("block")).otherwise(-1)
        model.table = store(met.groupBy(by, "part", own.alias("_block")).applyInArrow(add, schema), f"{path}/sweep-{sweep}")
        found = totals_of(model.table)
        model.totals = {r[by]: np.array([r[c] for c in names]) for r in found if not r["over"]}
        over = {r[by]: r for r in found if r["over"]}
        model.documents.append({name: r["documents"] for name, r in over.items()})
        model.priors = {name: new_prior(priors[name], np.array([r[c] for c in names]) / r["documents"], r["documents"])
                        for name, r in over.items()}
        release(spark, f"{path}/sweep-{sweep - 1}")

    def name_terms(terms: pa.Table, weights: pa.Table) -> pa.Table:
        listed = terms.column("terms").combine_chunks().flatten()
        found = np.frombuffer(weights.column("value")[0].as_py()).reshape(k, -1)
        return pa.table({by: pa.array([terms.column(by)[0].as_py()] * len(listed), pa.string()), "term": listed,
                         **{c: found[i] for i, c in enumerate(names)}})

    listed = vocabulary.where("block < 0").select(by, "part", "terms")
    last = model.table.where("block < 0").select(by, "part", "value")
    model.table = store(listed.groupBy(by, "part").cogroup(last.groupBy(by, "part")).applyInArrow(
        name_terms, f"`{by}` string, term string, {sums}"), f"{path}/table")
    release(spark, f"{path}/blocks", f"{path}/vocabulary", f"{path}/sweep-{sweeps}")
    return model


def lda_topics(docs: DataFrame, by: str = "polarity", classes: Sequence[str] = ("pos", "neg"), **options) -> TopicModel:
    """Topics of each class of documents, all classes in the same sweeps."""
    return fit_topics(docs, by=by, classes=classes, **options)


def topic_words(model: TopicModel, words: int = TOPIC_WORDS) -> DataFrame:
    """The heaviest words of every topic of every class."""
    return model.topics(words)


def topic_summary(model: TopicModel) -> DataFrame:
    """Per class and topic: its learned document prior, its number of terms and the sum of their weights."""
    sums = model.weights().groupBy(model.by, "topic").agg(
        F.count("*").alias("n_terms"), F.min("weight").alias("min_weight"),
        F.round(F.sum("weight"), 6).alias("total_weight"))
    return sums.join(model.document_priors(), [model.by, "topic"])
