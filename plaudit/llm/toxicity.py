"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm import simhash
from plaudit.llm.common import sample_labels, texts
from plaudit.scratch import new_path, store

# Labelled documents that the lexicon is learned from at most.
SAMPLE = 20_000

# Score from which a text counts as toxic.
CUT = 0.7

# A term is a whole word or the start of words, of these many characters.
PREFIXES = (4, 5, 6, 7, 8, 9)

# Toxic texts that a term needs, and how much likelier it must be in toxic texts than in others.
MIN_TEXTS, MIN_RATIO = 5, 10.0

# Letters of other scripts and signs that look like Latin letters, and digits that
# stand for them. A one may stand for i or l, so these three are one letter.
LOOKALIKES = dict(zip("авекмнорстухѕјԁɡοανερτυѵ", "abekmhopctyxsjdgoaveptuv")) | {
    "і": "l", "ι": "l", "ı": "l", "i": "l", "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """Code point -> folded text, worked out at first sight: small, without marks, look-alikes as Latin."""

    def __missing__(self, point: int) -> str:
        folded = ""
        for char in unicodedata.normalize("NFKD", chr(point)).lower():
            char = LOOKALIKES.get(char, char)
            if unicodedata.combining(char) or unicodedata.category(char) == "Cf":
                continue
            folded += char if char.isalpha() else " "
        self[point] = folded
        return folded


_FOLD = _Fold()


def fold(text: str) -> str:
    """Words of letters, one space between and around them."""
    return f" {' '.join(text.translate(_FOLD).split())} "


def terms(folded: str) -> set[str]:
    """Candidate terms of a text: ' word ' and the starts ' pref' of its words."""
    found = set()
    for word in set(folded.split()):
        if len(word) >= PREFIXES[0]:
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in PREFIXES if n < len(word))
    return found


@dataclass
class Lexicon:
    """Weights of terms, exception phrases, and the line that turns a total into a score."""
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    _machine: object = None

    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._machine.add_word(phrase, (None, len(phrase)))
            for term, weight in self.weights.items():
                if term not in self.exceptions:
                    self._machine.add_word(term, (weight, len(term)))
            self._machine.make_automaton()
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight): the heaviest term at each place, without places inside an exception phrase."""
        if not self.weights:
            return []
        best: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        for end, (weight, length) in self.machine().iter(folded):
            start = end - length + 1
            if weight is None:
                free.append((start, end))
            elif start not in best or weight > best[start][1]:
                best[start] = (end, weight)
        if free:
            # Phrases in order; those that overlap or touch are one stretch.
            free.sort()
            edge = -1
            inside = set()
            for start, end in free:
                inside.update(p for p in range(max(start, edge), end) if p in best)
                edge = max(edge, end)
            for place in inside:
                del best[place]
        return [(start, end, weight) for start, (end, weight) in sorted(best.items())]

    def total(self, folded: str) -> float:
        """Weight of all matches over the logarithm of the length in words."""
        return sum(w for _, _, w in self.matches(folded)) / (1.0 + math.log1p(folded.count(" ")))

    def score(self, text: str) -> float:
        margin = self.slope * self.total(fold(text)) + self.shift
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, margin))))

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}


def _count(texts_and_labels: DataFrame, emit) -> DataFrame:
    """(term, toxic, clean): texts of each label that hold a term, counted in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in batches:
            for text, label in zip(texts(batch), batch.column("label").to_pylist()):
                counts[label].update(emit(fold(text.decode())))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush(counts)
        yield flush(counts)

    def flush(counts) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()),
             pa.array([counts[0][n] for n in names], pa.int64())], ["term", "toxic", "clean"])
        counts[0].clear()
        counts[1].clear()
        return out

    rows = texts_and_labels.select("text", "label").mapInArrow(run, "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _learned_terms(counts: list, toxic: int, clean: int) -> dict[str, float]:
    """Log-odds weights; a term goes if a shorter one in the lexicon starts it and is as telling."""
    weights: dict[str, float] = {}
    for row in sorted(counts, key=lambda r: (len(r["term"]), r["term"])):
        weight = math.log((row["toxic"] + 0.5) / (toxic + 1)) - math.log((row["clean"] + 0.5) / (clean + 1))
        shorter = [weights[row["term"][:n]] for n in range(2, len(row["term"])) if row["term"][:n] in weights]
        if not shorter or weight > max(shorter) + 1.0:
            weights[row["term"]] = weight
    return weights


def _fit_line(totals: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic line, by Newton steps with a small ridge on the slope."""
    rows = np.column_stack([totals, np.ones(len(totals))])
    line = np.zeros(2)
    for _ in range(50):
        chance = 1.0 / (1.0 + np.exp(-np.clip(rows @ line, -30, 30)))
        gradient = rows.T @ (chance - labels) / len(labels) + np.array([1e-4, 0]) * line
        curve = (rows * (chance * (1 - chance))[:, None]).T @ rows / len(labels) + np.diag([1e-4, 1e-8])
        step = np.linalg.solve(curve, gradient)
        line -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(line[0])), float(line[1])


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, min_texts: int = MIN_TEXTS, min_ratio: float = MIN_RATIO) -> Lexicon:
    """Learn terms, exception phrases and the score line from at most about ``sample`` labelled rows.

    Copies count once: of texts of one label that are near copies of each other once folded
    (``simhash.near_copies``: shared shingles, counted exactly), the one with the smallest key is used.
    Terms need ``min_texts`` toxic texts and must be ``min_ratio`` times likelier there. Exception
    phrases are a term's word with the word before or after it that only clean texts hold,
    ``min_texts`` of them at least. Without both labels nothing matches and the score is the share
    of label 1.
    """
    chosen = sample_labels(labels, column, key, sample)
    known = docs.where(F.col(key).isNotNull()).select(key, F.col(text).alias("text")).join(chosen, key)
    path = new_path(docs.sparkSession, "toxic")
    kind = docs.schema[key].dataType.simpleString()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([fold(t.decode()) for t in texts(batch)], pa.string()), batch.column("label")],
                [key, "text", "label"])

    known = store(known.select(key, "text", "label").mapInArrow(folded, f"`{key}` {kind}, text string, label int"), f"{path}/folded")
    parts = simhash.near_copies(known, key).distinct().toDF("_key", "_version", "part")
    known = known.withColumn("version", simhash.text_version("text")).join(
        parts, (F.col(key) == F.col("_key")) & (F.col("version") == F.col("_version")))
    known = known.groupBy("part", "label").agg(F.min_by("text", F.struct(key, "version")).alias("text"))
    known = store(known, f"{path}/sample")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = min(0.999, max(0.001, toxic / (toxic + clean) if toxic + clean else 0.001))
        return Lexicon({}, shift=math.log(share / (1 - share)))
    counts = _count(known, terms)
    telling = (F.col("toxic") + 0.5) / (toxic + 1) >= min_ratio * (F.col("clean") + 0.5) / (clean + 1)
    lexicon = Lexicon(_learned_terms(counts.where((F.col("toxic") >= min_texts) & telling).collect(), toxic, clean))

    def phrases(folded: str) -> set[str]:
        found = set()
        for start, end, _ in lexicon.matches(folded):
            stop = folded.index(" ", start + 1)
            after = folded.find(" ", stop + 1)
            before = folded.rfind(" ", 0, start)
            if after > 0:
                found.add(folded[start:after + 1])
            if before >= 0:
                found.add(folded[before:stop + 1])
        return found

    if lexicon.weights:
        harmless = _count(known, phrases).where(f"toxic = 0 AND clean >= {int(min_texts)}").collect()
        lexicon.exceptions = sorted(r["term"] for r in harmless)
        lexicon._machine = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [lexicon.total(fold(t.decode())) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.float64()), batch.column("label")], ["total", "label"])

    found = known.select("text", "label").mapInArrow(run, "total double, label int").toPandas().sort_values(["label", "total"])
    lexicon.slope, lexicon.shift = _fit_line(found["total"].to_numpy(float), found["label"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row; a null text counts as empty and matches nothing."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.score(t.decode()) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.float64())], ["key", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
