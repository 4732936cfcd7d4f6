"""Language-model scores of texts: the marginal chance of all segmentations into subword pieces."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm.common import remainder, split_words, texts
from plaudit.scratch import new_path, release, store

# A piece of up to 8 bytes is looked up as one packed number, a longer one by a hash that goes on
# from its first 8 bytes with this factor, and its bytes are compared then.
PACKED, FACTOR = 8, 0x9E3779B97F4A7C15

# Passes in which the piece scores are fitted to the words of the corpus.
PASSES = 2

# A word is frequent if it is at least one in HEAD training tokens, so there are at most HEAD
# frequent words, whatever the corpus: their scores are broadcast. All others are joined.
HEAD = 200_000

# Share of the training rows from which a language is a class of its own.
CLASS_SHARE = 0.05

# The token that ends a text. White space cannot be part of a word.
END = b"\n"

# Chance of an end where nothing was learned.
BLANK_END = 0.01


def _piece_key(piece: bytes) -> int:
    key = int.from_bytes(piece[:PACKED], "little")
    for byte in piece[PACKED:]:
        key = (key * FACTOR + byte) % (1 << 64)
    return key


def _fits(piece: bytes) -> bool:
    """If a piece can stand in a word with one space before it."""
    bare = piece.removeprefix(b" ")
    return piece == b" " or (len(bare.split()) == 1 and bare == bare.strip())


@dataclass
class Pieces:
    """Beginnings of the vocabulary pieces by length, and natural log scores of the pieces.

    For each length the sorted keys of all beginnings, the piece that each of them is (or -1), if
    a longer piece goes on from it, and the bytes of each piece.
    """
    keys: list[np.ndarray]
    ids: list[np.ndarray]
    longer: list[np.ndarray]
    spelled: list[np.ndarray]
    scores: np.ndarray
    stop: float

    @staticmethod
    def existing(ranks: dict[bytes, int]) -> Pieces:
        """Pieces of an existing vocabulary. Until they are fitted, a score falls with the rank.

        Left out are only entries with white space elsewhere than one space in front, which no
        word holds. All single bytes must be in the vocabulary, so every word has a segmentation.
        """
        tokens = sorted(filter(_fits, ranks), key=ranks.get)
        keys, ids, longer, spelled = [], [], [], []
        most = max(map(len, tokens))
        wholes, opens = [{} for _ in range(most + 1)], [set() for _ in range(most + 1)]
        for i, token in enumerate(tokens):
            if wholes[len(token)].setdefault(_piece_key(token), i) != i:
                raise ValueError("two pieces of the vocabulary have one key")
            for n in range(1, len(token)):
                opens[n].add(_piece_key(token[:n]))
        for n, (whole, open_) in enumerate(zip(wholes[1:], opens[1:]), 1):
            own = sorted(whole.keys() | open_)
            keys.append(np.array(own, np.uint64))
            ids.append(np.array([whole.get(k, -1) for k in own], np.int64))
            longer.append(np.array([k in open_ for k in own], bool))
            letters = [tokens[whole[k]] if k in whole else bytes(n) for k in own]
            spelled.append(np.frombuffer(b"".join(letters), np.uint8).reshape(-1, n) if n > PACKED else np.empty((0, n), np.uint8))
        weights = 1.0 / (10.0 + np.arange(len(tokens)))
        return Pieces(keys, ids, longer, spelled, np.log(0.8 * weights / weights.sum()), math.log(0.2))

    def with_counts(self, counts: np.ndarray, words: float) -> Pieces:
        """Scores after a pass: expected counts plus a small share for every piece."""
        smooth = counts + 0.01
        total = smooth.sum() + words
        return Pieces(self.keys, self.ids, self.longer, self.spelled, np.log(smooth / total), math.log(max(words, 1e-9) / total))

    def found(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(n, piece id or -1 at [word, start]) for words of one length; lengths that fit nowhere are left out.

        A start is looked up for as long as a longer piece begins with what stands there.
        """
        count, length = words.shape
        out = []
        row, start = (a.ravel() for a in np.indices((count, length)))
        packed = np.zeros(count * length, np.uint64)
        for n in range(1, min(len(self.keys), length) + 1):
            last = words[row, start + (n - 1)]
            packed = packed | last << np.uint64(8 * (n - 1)) if n <= PACKED else packed * np.uint64(FACTOR) + last
            keys = self.keys[n - 1]
            at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
            begins = np.nonzero(keys[at] == packed)[0]
            row, start, packed, at = row[begins], start[begins], packed[begins], at[begins]
            piece = self.ids[n - 1][at]
            if n > PACKED:
                same = (words[row[:, None], start[:, None] + np.arange(n)] == self.spelled[n - 1][at]).all(axis=1)
                piece = np.where(same, piece, -1)
            if (piece >= 0).any():
                ids = np.full((count, length - n + 1), -1, np.int32)
                ids[row, start] = piece
                out.append((n, ids))
            on = np.nonzero(self.longer[n - 1][at] & (start + n < length))[0]
            row, start, packed = row[on], start[on], packed[on]
            if not len(row):
                break
        return out

    def forward(self, words: np.ndarray, found: list | None = None) -> tuple[np.ndarray, list]:
        """Log-space forward recursion over all words of one length: alpha at every byte, and arc scores."""
        found = self.found(words) if found is None else found
        count, length = words.shape
        arcs = [(n, np.where(ids >= 0, self.scores[ids], -np.inf)) for n, ids in found]
        alpha = np.full((length + 1, count), -np.inf)
        alpha[0] = 0.0
        for end in range(1, length + 1):
            alpha[end] = np.logaddexp.reduce([alpha[end - n] + arc[:, end - n] for n, arc in arcs if n <= end], axis=0)
        return alpha, arcs

    def marginal(self, words: np.ndarray) -> np.ndarray:
        """Log chance of each word: the sum over its segmentations, and the stop after the last piece."""
        return self.forward(words)[0][-1] + self.stop

    def expected(self, words: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over the words, by the forward and backward sums."""
        found = self.found(words)
        alpha, arcs = self.forward(words, found)
        count, length = words.shape
        beta = np.full((length + 1, count), -np.inf)
        beta[length] = 0.0
        totals = np.zeros(len(self.scores))
        for start in range(length - 1, -1, -1):
            ways = np.stack([arc[:, start] + beta[start + n] for n, arc in arcs if n <= length - start])
            beta[start] = np.logaddexp.reduce(ways, axis=0)
            share = np.exp(ways + alpha[start] - alpha[length])
            ids = np.stack([ids[:, start] for n, ids in found if n <= length - start])
            totals += np.bincount(ids[ids >= 0], share[ids >= 0], len(totals))
        return totals


def by_length(words: list[bytes], rows: int = 8192, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes) of the words, those of one length together, at most ``rows`` at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    starts = np.concatenate([[0], np.nonzero(np.diff(lengths[order]))[0] + 1, [len(order)]])
    for s, e in zip(starts[:-1], starts[1:]):
        length = int(lengths[order[s]]) if e > s else 0
        step = max(1, min(rows, cells // max(1, length)))
        for i in range(s, e, step):
            places = order[i:min(e, i + step)]
            block = np.frombuffer(b"".join([words[p] for p in places]), np.uint8)
            yield places, block.reshape(len(places), length).astype(np.uint64)


def text_classes(docs: DataFrame, by: str, share: float = CLASS_SHARE) -> tuple[dict, np.ndarray]:
    """Class number of each value of ``by`` with at least ``share`` of the rows, and the classes' shares.

    Class 0 takes all other values and null; there are at most 1 / share other classes.
    """
    sizes = docs.groupBy(F.col(by).cast("string").alias("by")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(F.col("by").isNotNull() & (F.col("n") >= share * total)).orderBy("by").collect() if total else []
    numbers = {row["by"]: i for i, row in enumerate(large, 1)}
    met = np.array([total - sum(r["n"] for r in large), *[r["n"] for r in large]], float) + 0.5
    return numbers, met / met.sum()


def word_counts(docs: DataFrame, text: str, group: str, groups: int) -> DataFrame:
    """(word, n): training tokens of each distinct word of all texts, one number for each class.

    ``group`` is the class of a training row and null for others, whose words count nothing.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(group).alias("group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(groups + 1)]
        for batch in batches:
            for value, group in zip(texts(batch), batch.column("group").to_pylist()):
                words = split_words(value.lower())
                if group is None:
                    counts[groups].update(words)
                else:
                    counts[group].update(words)
                    counts[group][END] += 1
                if sum(map(len, counts)) > 400_000:
                    yield flush(counts)
        yield flush(counts)

    def flush(counts: list[Counter]) -> pa.RecordBatch:
        words = [word for counter in counts for word in counter]
        number = np.repeat(np.arange(groups + 1, dtype=np.int32), [len(c) for c in counts])
        n = np.array([n for counter in counts for n in counter.values()], np.int64)
        for counter in counts:
            counter.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(number), pa.array(n)], ["word", "group", "n"])

    met = rows.mapInArrow(run, "word binary, group int, n long")
    return met.groupBy("word").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("group") == k, F.col("n"))), F.lit(0)) for k in range(groups)]).alias("n"))


def fit_pieces(counts: DataFrame, pieces: list[Pieces], passes: int = PASSES) -> list[Pieces]:
    """Fit the scores of each class to its distinct training words: each pass is one job over all of them.

    Every distinct word counts once, as the pieces stand for words that are rare or new. What
    reaches the driver is one number for each class and piece of the vocabulary.
    """
    words = counts.where(F.col("word") != F.lit(END))
    size = len(pieces[0].scores) + 1
    for _ in range(passes):
        shared = counts.sparkSession.sparkContext.broadcast(pieces)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((len(shared.value), size))
            for batch in batches:
                held, n = batch.column("word").to_pylist(), _matrix(batch.column("n"), np.int64)
                for group, model in enumerate(shared.value):
                    own = [b" " + held[i] for i in np.nonzero(n[:, group])[0]]
                    totals[group, -1] += len(own)
                    for _, block in by_length(own):
                        totals[group, :-1] += model.expected(block)
            group, piece = np.nonzero(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int64()), pa.array(piece, pa.int64()), pa.array(totals[group, piece])], ["group", "piece", "uses"])

        found = words.mapInArrow(run, "group long, piece long, uses double").groupBy("group", "piece").agg(
            F.sum("uses").alias("uses")).toPandas()
        totals = np.zeros((len(pieces), size))
        totals[found["group"].to_numpy(int), found["piece"].to_numpy(int)] = found["uses"].to_numpy(float)
        pieces = [p.with_counts(t[:-1], t[-1]) for p, t in zip(pieces, totals)]
    return pieces


def _matrix(column: pa.ListArray, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


@dataclass
class Totals:
    """Training tokens, distinct ones, and how many were met once and twice."""
    tokens: int
    distinct: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return min(0.95, max(0.05, self.once / (self.once + 2 * self.twice))) if self.once else 0.5

    def rest(self) -> float:
        """Chance left for segmentations: what the discount takes from the words that were met."""
        return self.discount * self.distinct / self.tokens if self.tokens else 1.0

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def token_scores(words: list[bytes], n: np.ndarray, pieces: list[Pieces], totals: list[Totals], whole: Totals) -> np.ndarray:
    """log10 chance of each token in each class, [token, class].

    The arc of the whole word as met in the class, then as met anywhere, each discounted, plus
    what the discounts left times the sum over all segmentations into pieces of the class.
    """
    end = np.fromiter((word == END for word in words), bool, len(words))
    subword = np.nonzero(~end)[0]
    logs = np.full((len(words), len(pieces)), math.log(BLANK_END))
    for places, block in by_length([b" " + words[i] for i in subword]):
        found = pieces[0].found(block)
        for k, model in enumerate(pieces):
            logs[subword[places], k] = model.forward(block, found)[0][-1] + model.stop + math.log1p(-BLANK_END)
    met = np.maximum(n.sum(axis=1) - whole.discount, 0)[:, None] / max(1, whole.tokens)
    own = np.maximum(n - np.array([t.discount for t in totals]), 0) / np.array([max(1, t.tokens) for t in totals])
    with np.errstate(divide="ignore"):
        anywhere = np.logaddexp(np.log(met), logs + math.log(whole.rest()))
        return np.logaddexp(np.log(own), anywhere + np.log([t.rest() for t in totals])) / math.log(10)


def score_words(counts: DataFrame, pieces: list[Pieces], totals: list[Totals], whole: Totals) -> DataFrame:
    """(word, n, base, score) of every distinct word: training tokens, and the scores in each class."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _matrix(batch.column("n"), np.int64)
            found = token_scores(batch.column("word").to_pylist(), n, shared.value, totals, whole).astype(np.float32)
            offsets = pa.array(np.arange(0, found.size + 1, found.shape[1] or 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(n.sum(axis=1)), pa.array(whole.base(n.sum(axis=1))),
                 pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["word", "n", "base", "score"])

    return counts.select("word", "n").mapInArrow(run, "word binary, n long, base double, score array<float>")


def _document_rows(docs: DataFrame, head: tuple[dict, np.ndarray], kind: str) -> DataFrame:
    """(row, word, uses, ...): one row of what the frequent words give, and one for each rare word.

    The first has a word that no text can hold, a space and the row number, so it meets no score
    and lands anywhere.
    """
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, table = shared.value
        for batch in batches:
            row, word, uses, base, score, known, count, keys = [], [], [], [], [], [], [], []
            for r, key, value in zip(batch.column("row").to_pylist(), batch.column("key").to_pylist(), texts(batch)):
                tokens = split_words(value.lower())
                rare, met, times = [], [], []
                for token, n in [*Counter(tokens).items(), (END, 1)]:
                    place = frequent.get(token)
                    if place is None:
                        rare.append((token, n))
                    else:
                        met.append(place)
                        times.append(n)
                sums = np.array(times, float) @ table[met] if met else np.zeros(table.shape[1])
                row += [r] * (len(rare) + 1)
                word.append(b" %d" % r)
                word += [w for w, _ in rare]
                uses.append(0)
                uses += [u for _, u in rare]
                for column, first in ((base, sums[1]), (score, sums[2:].tolist()), (known, int(sums[0])), (count, len(tokens) + 1), (keys, key)):
                    column.append(first)
                    column += [None] * len(rare)
                if len(row) > 200_000:
                    yield rows(row, word, uses, base, score, known, count, keys)
                    row, word, uses, base, score, known, count, keys = [], [], [], [], [], [], [], []
            yield rows(row, word, uses, base, score, known, count, keys)

    def rows(row, word, uses, *rest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(word, pa.binary()), pa.array(uses, pa.int32()),
             pa.StructArray.from_arrays(
                 [pa.array(c, t) for c, t in zip(rest, (pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), key_type))],
                 ["base", "score", "known", "count", "key"],
                 mask=pa.array([c is None for c in rest[3]]))], ["row", "word", "uses", "own"])

    plain = docs.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    key_type = pa.string() if kind == "string" else pa.int64()
    return plain.mapInArrow(run, f"row long, word binary, uses int, own struct<base:double,score:array<double>,known:long,count:long,key:{kind}>")


def score_texts(docs: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text", by: str = "lang",
                divisor: int = 5, held: int = 1, head: int = HEAD, passes: int = PASSES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Tokens are the lower-cased words of a text and one end. The chance of a text is the mean over
    the classes of ``by`` (languages), weighted by their shares of the training rows, of the
    product of its tokens' chances in the class; the row's own class is not used. A token's chance
    is that of its whole word, discounted, as met in the class and anywhere in training, plus what
    the discounts left times the sum over all segmentations of the word, with a space before it,
    into pieces of the vocabulary ``ranks``, whose scores were fitted to the training words of the class. Chances of
    all tokens of a class add up to one.

    Learned from the rows whose crc32 of the key modulo ``divisor`` is not ``held``; a null key
    counts as the empty text, a null text as empty (one token, the end). Without training rows the
    chances are those of the unfitted pieces. Repeated rows and keys are scored each on its own.
    """
    path = new_path(docs.sparkSession, "lattice")
    kind = docs.schema[key].dataType.simpleString()
    kind = kind if kind == "string" else "bigint"
    plain = docs.select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text"), F.col(by).cast("string").alias("by"),
                        (remainder(key, divisor) == held).alias("held_out"))
    numbers, shares = text_classes(plain.where("NOT held_out"), "by")
    groups = len(shares)
    group = F.lit(0)
    for value, number in numbers.items():
        group = F.when(F.col("by") == value, number).otherwise(group)
    counts = store(word_counts(plain.withColumn("group", F.when(~F.col("held_out"), group)), "text", "group", groups), f"{path}/counts")
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    each = [total, *[F.get("n", F.lit(k)) for k in range(groups)]]
    sums = counts.agg(*[part for n in each for part in (
        F.sum(n), F.count_if(n > 0), F.count_if(n == 1), F.count_if(n == 2))]).first()
    whole, *totals = [Totals(*[int(v or 0) for v in sums[i:i + 4]]) for i in range(0, 4 * len(each), 4)]
    pieces = fit_pieces(counts, [Pieces.existing(ranks)] * groups, passes if whole.tokens else 0)
    words = store(score_words(counts, pieces, totals, whole), f"{path}/words")
    release(docs.sparkSession, f"{path}/counts")
    edge = max(1, -(-whole.tokens // head))
    frequent = {bytes(r["word"]): [1.0, r["base"], *r["score"]] for r in words.where(F.col("n") >= edge).collect()} if whole.tokens else {}
    if END not in frequent:
        # Nothing was learned, so no word count has the end.
        none = np.zeros((1, groups), np.int64)
        frequent[END] = [0.0, whole.base(np.zeros(1))[0], *token_scores([END], none, pieces, totals, whole)[0]]
    table = np.array(list(frequent.values()), float)
    rows = _document_rows(plain, ({word: i for i, word in enumerate(frequent)}, table), kind)
    rare = words.where(F.col("n") < edge).select("word", (F.col("n") > 0).cast("int").alias("known"), "base", "score")
    joined = rows.join(rare, "word", "left")
    found = joined.groupBy("row").agg(
        F.max_by("own", F.col("own").isNotNull()).alias("own"), F.sum(F.col("uses") * F.col("known")).alias("known"),
        F.sum(F.col("uses") * F.col("base")).alias("base"),
        *[F.sum(F.col("uses") * F.get("score", F.lit(k)).cast("double")).alias(f"score_{k}") for k in range(groups)])
    logs = [F.get("own.score", F.lit(k)) + F.coalesce(F.col(f"score_{k}"), F.lit(0.0)) + F.lit(math.log10(shares[k]))
            for k in range(groups)]
    top = F.array_max(F.array(*logs))
    mean = F.aggregate(F.array(*logs), F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.col("top")))
    return found.withColumn("top", top).select(
        F.col("own.key").alias(key), (remainder("own.key", divisor) == held).alias("held_out"),
        F.col("own.count").alias("n_tokens"), (F.col("own.known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(whole.tokens).cast("long").alias("train_tokens"),
        (F.col("own.base") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("top") + F.log10(mean)).alias("score"))
