"""Bradley-Terry document quality: pairwise logistic ranking and a quantile threshold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm.common import sample_labels, split_words, texts

# Labelled documents that a model is fitted on at most, and pairs drawn for each of them.
SAMPLE, PAIRS = 20_000, 8

# Share at which a score counts as label 1.
CUT = 0.3

NAMES = ("symbols", "shouts", "capitals", "digits", "repeated_lines", "stutter", "repeated_words",
         "word_length", "bare_symbols", "variety", "stops", "few_words")

# Classes of bytes: 1 symbols that prose has not, 2 shouting, 3 capitals, 4 small letters,
# 5 digits, 6 stops, 7 bytes of letters outside ASCII.
_CLASS = np.zeros(256, np.uint8)
for _number, _members in enumerate((b"#*$%&|<>^~=_\\{}[]@+`", b"!?", bytes(range(65, 91)), bytes(range(97, 123)),
                                    bytes(range(48, 58)), b".,;:", bytes(range(128, 256))), 1):
    _CLASS[list(_members)] = _number


def features(text: bytes) -> np.ndarray:
    """Measures of a text between 0 and about 1. An empty text has ``few_words`` only.

    Each is a share or a rate through x / (x + c), so a very long text weighs like a short one.
    """
    out = np.zeros(len(NAMES))
    words = split_words(text)
    n = len(words)
    out[11] = 1.0 / (1.0 + n / 10.0)
    if not n:
        return out
    symbols, shouts, capitals, small, digits, stops, wide = np.bincount(
        _CLASS[np.frombuffer(text, np.uint8)], minlength=8)[1:].tolist()
    letters = capitals + small + wide
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:], words[3:]))
    seen: set = set()
    again = {w for w in windows if w in seen or seen.add(w)}
    out[0] = symbols / n / (symbols / n + 0.25)
    out[1] = shouts / n / (shouts / n + 0.25)
    out[2] = capitals / max(1, letters)
    out[3] = digits / max(1, letters + digits)
    out[4] = 1.0 - len(set(lines)) / len(lines)
    out[5] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[6] = sum(w in again for w in windows) / max(1, len(windows))
    length = letters / n
    out[7] = length / (length + 6.0)
    out[8] = sum(len(w) == 1 and _CLASS[w[0]] == 1 for w in words) / n
    out[9] = np.log1p(len(set(words))) / np.log1p(n)
    out[10] = stops / n / (stops / n + 0.25)
    return out


def document_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features): the measures of every whole text. A null text counts as empty."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(found, pa.list_(pa.float64()))], ["key", "features"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, features array<double>").withColumnRenamed("key", key)


@dataclass
class Ranking:
    """score = logistic(slope * (weights . features - threshold) + logit(cut))."""
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        margin = self.slope * (rows @ self.weights - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def fit_pairs(rows: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Bradley-Terry weights: logistic loss on the feature differences of preference pairs.

    Every document is paired with ``pairs`` seeded ones of the other label; Newton steps on the
    mean loss with a ridge.
    """
    rng = np.random.default_rng(seed)
    good, bad = rows[labels == 1], rows[labels == 0]
    better = np.concatenate([np.repeat(good, pairs, axis=0), good[rng.integers(0, len(good), pairs * len(bad))]])
    worse = np.concatenate([bad[rng.integers(0, len(bad), pairs * len(good))], np.repeat(bad, pairs, axis=0)])
    difference = better - worse
    weights = np.zeros(rows.shape[1])
    for _ in range(25):
        chance = 1.0 / (1.0 + np.exp(np.clip(difference @ weights, -30, 30)))
        gradient = -difference.T @ chance / len(difference) + ridge * weights
        curve = (difference * (chance * (1 - chance))[:, None]).T @ difference / len(difference)
        step = np.linalg.solve(curve + ridge * np.eye(len(weights)), gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit(rows: np.ndarray, labels: np.ndarray, cut: float = CUT) -> Ranking:
    """Weights from pairs; the threshold is the score quantile at the share of label 0.

    With one label only there are no pairs: every score is then the share of label 1 (one half
    without labels).
    """
    if not len(labels) or labels.min() == labels.max():
        share = np.clip(labels.mean() if len(labels) else 0.5, 0.001, 0.999)
        return Ranking(np.zeros(len(NAMES)), 0.0, 0.0, float(share))
    weights = fit_pairs(rows, labels)
    points = rows @ weights
    threshold = float(np.quantile(points, float((labels == 0).mean()), method="midpoint"))
    # The slope that fits the labels best, the threshold being fixed at ``cut``.
    margins, base = points - threshold, np.log(cut / (1 - cut))
    slopes = np.geomspace(0.1, 50, 60)
    losses = [np.logaddexp(0, np.where(labels == 1, -1, 1) * (s * margins + base)).mean() for s in slopes]
    return Ranking(weights, threshold, float(slopes[int(np.argmin(losses))]), cut)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> Ranking:
    """Fit on at most about ``sample`` labelled documents; their features are all that is gathered."""
    chosen = sample_labels(labels, column, key, sample)
    known = docs.where(F.col(key).isNotNull()).select(key, F.col(text).alias("text")).join(chosen, key)
    found = document_features(known.withColumn("_both", F.struct(key, "label")), "_both", "text").select(
        F.col("_both")[key].alias("key"), F.col("_both.label").alias("label"), "features").toPandas()
    found = found.sort_values("key", kind="stable")
    rows = np.array(found["features"].tolist(), float).reshape(-1, len(NAMES))
    return fit(rows, found["label"].to_numpy(int))


def score(docs: DataFrame, model: Ranking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row of ``docs``; higher is likelier label 1."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([features(t) for t in texts(batch)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.score(found))], ["key", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Ranking, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, judged where they lie."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([features(t) for t in texts(batch, text)]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.score(found) >= cut))

    return docs.mapInArrow(run, docs.schema).select(*names)
