"""Quality rules and the perplexity of a modified Kneser-Ney model over n-grams of spelled characters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from plaudit.llm.common import SPACES, split_words, texts
from plaudit.scratch import new_path, store

# Characters counted as symbols, words of a repeat window, and the limits of the base rules.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = "#*$%&|<>", 5, 10, 20

# Stops, told apart behind a symbol that they share.
STOPS = ".,;:'\"-()!?"

# Order of the model and bits of a symbol; characters other than letters a-z are spelled in several symbols.
# The model has at most 2^(ORDER * BITS) n-grams (16.8 million) of any order, however large the corpus:
# that bounds what is gathered and broadcast.
ORDER, BITS = 4, 6

# A document is rejected when its log perplexity is further from its language's median than BAND
# robust deviations plus LENGTH over the root of its number of words: short texts vary more.
BAND, LENGTH = 4.0, 1.5

# The same for the documents that the second model is counted over, from the perplexities of the first.
INNER_BAND, INNER_LENGTH = 1.5, 0.4

# Smallest robust deviation: a language that is mostly copies of one text has no spread of its own.
LEAST_SPREAD = 0.04

# Log perplexities are counted in steps of 1 / STEPS for the bands.
STEPS = 1000


def _spellings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its symbols packed into one number, how many they are, and whether it is a sign.

    Symbols: 0 space, 1-26 letters a-z of either case, 29 any symbol of the base rule. All other
    characters are spelled, each in its own way: 27 and a digit; 28 and a stop; and by five bits a symbol
    (32-63) two for the code points below 0x200, three below 0x3e00, 63 and three below 0xbe00, 31 and
    three below 0x13e00, 30 and four for the rest. The first symbol tells where a character ends, so no
    two texts are spelled alike but for case, symbols of the base rule and repeats of one sign.
    """
    points = np.arange(0x110000, dtype=np.uint32)
    codes, sizes = np.zeros(len(points), np.uint32), np.zeros(len(points), np.uint8)
    # First and last code point, first symbol (none: it has bits of the number too), symbols after it.
    for low, high, lead, digits in ((0, 0x200, None, 2), (0x200, 0x3E00, None, 3), (0x3E00, 0xBE00, 63, 3),
                                    (0xBE00, 0x13E00, 31, 3), (0x13E00, 0x110000, 30, 4)):
        own = points[low:high] - np.uint32(low)
        for i in range(digits):
            digit = (own >> np.uint32(5 * (digits - 1 - i))) & np.uint32(31)
            # Of the symbols that begin a number, 32-47 are for two and 48-62 for three.
            first = 48 if lead is None and digits == 3 and i == 0 else 32
            codes[low:high] = codes[low:high] << np.uint32(BITS) | (digit + np.uint32(first))
        if lead is not None:
            codes[low:high] |= np.uint32(lead << BITS * digits)
        sizes[low:high] = digits + (lead is not None)
    for i in range(26):
        codes[[ord("a") + i, ord("A") + i]], sizes[[ord("a") + i, ord("A") + i]] = i + 1, 1
    for members, lead in (("0123456789", 27), (STOPS, 28)):
        for i, char in enumerate(members):
            codes[ord(char)], sizes[ord(char)] = lead << BITS | 32 + i, 2
    for members, symbol in ((SYMBOLS, 29), (SPACES, 0)):
        for char in members:
            codes[ord(char)], sizes[ord(char)] = symbol, 1
    signs = np.zeros(len(points), bool)
    signs[[i for i in range(128) if not chr(i).isalnum() and chr(i) not in SPACES]] = True
    return codes, sizes, signs


_CODES, _SIZES, _SIGNS = _spellings()


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = split_words(text)
    decoded = text.decode()
    chars = len(decoded) - sum(decoded.count(c) for c in SPACES)
    symbols = sum(decoded.count(c) for c in SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that stand in the text twice or more."""
    if len(words) <= WINDOW:
        return 0
    # Equal windows have equal hashes, so without an equal pair of hashes there is nothing to compare.
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    mixed = np.zeros(len(words) - WINDOW + 1, np.int64)
    for i in range(WINDOW):
        mixed = mixed * np.int64(0x9E3779B97F4A7C1) + hashes[i:i + len(mixed)]
    mixed.sort()
    if (mixed[1:] != mixed[:-1]).all():
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    counts = Counter(windows)
    repeats = covered = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            repeats += i + WINDOW - max(i, covered)
            covered = i + WINDOW
    return repeats


def ngram_keys(text: bytes, order: int = ORDER) -> np.ndarray:
    """Packed n-grams of the symbols that spell the words of a text, one space before, between and after them.

    Neighbours of one sign count as one, so a run of signs does not look predictable. The text
    starts with ``order - 1`` spaces of context, so every symbol after has a full n-gram.
    """
    words = split_words(text)
    if not words:
        return np.empty(0, np.int64)
    points = np.frombuffer(b" ".join(words).decode().encode("utf-32-le"), np.uint32)
    codes, again = _CODES[points], _SIGNS[points]
    again[1:] &= codes[1:] == codes[:-1]
    again[0] = False
    sizes = _SIZES[points]
    if again.any():
        codes, sizes = codes[~again], sizes[~again]
    ends = np.cumsum(sizes, dtype=np.int64)
    symbols = np.empty(ends[-1], np.int64)
    # From the last symbol of each character to its first.
    symbols[ends - 1] = codes & 63
    for i in range(1, int(sizes.max())):
        longer = np.nonzero(sizes > i)[0]
        symbols[ends[longer] - 1 - i] = codes[longer] >> np.uint32(BITS * i) & np.uint32(63)
    row = np.zeros(len(symbols) + order, np.int64)
    row[order - 1:-1] = symbols
    keys = row[:len(row) - order + 1].copy()
    for i in range(1, order):
        keys = keys << BITS | row[i:len(row) - order + 1 + i]
    return keys


def stretches(values: list[bytes], size: int = 2_000_000) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """The n-grams of the texts, in stretches of whole texts that end when they hold ``size``."""
    start, rows, held = 0, [], 0
    for i, value in enumerate(values):
        rows.append(ngram_keys(value))
        held += len(rows[-1])
        if held > size or i == len(values) - 1:
            yield slice(start, i + 1), rows
            start, rows, held = i + 1, [], 0


def base_failed(n_words, n_repeat_words):
    """Fewer than ten words, or more than a fifth of them in repeated windows; for numbers and columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def count_ngrams(docs: DataFrame, text: str = "text", inside: Broadcast | None = None) -> DataFrame:
    """(gram, n): packed n-grams of all texts, counted in each task before they meet.

    With a broadcast model as ``inside``, of the texts that pass the base rules and whose log
    perplexity under it is within the columns ``low`` and ``high`` of their row, widened for
    short texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            values = texts(batch)
            for place, rows in stretches(values):
                if inside:
                    low, high = (batch.column(c).slice(place.start, len(rows)).to_pylist() for c in ("low", "high"))
                    surprises = inside.value.mean_surprises(rows)
                    rows = [row for row, *rest in zip(rows, values[place], surprises, low, high) if fits(*rest)]
                grams, counts = add(grams, counts, rows)
        if len(grams):
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], ["gram", "n"])

    def fits(value: bytes, surprise: float, low: float | None, high: float | None) -> bool:
        words = split_words(value)
        more = INNER_LENGTH / np.sqrt(max(1, len(words)))
        if low is None or not low - more <= surprise <= high + more:
            return False
        return not base_failed(len(words), repeat_words(words))

    def add(grams, counts, stretch):
        new, n = np.unique(np.concatenate([np.empty(0, np.int64), *stretch]), return_counts=True)
        both, place = np.unique(np.concatenate([grams, new]), return_inverse=True)
        summed = np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
        return both, summed

    rows = docs.select(F.col(text).alias("text"), *(("low", "high") if inside else ())).mapInArrow(run, "gram long, n long")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted hash arrays of each order: n-grams, their discounted share, and weights of their contexts."""
    grams: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    _logs: np.ndarray | None = None

    def log_chances(self, keys: np.ndarray) -> np.ndarray:
        """Natural log of the chance of the last character of each n-gram, interpolated up the orders."""
        chance = np.full(len(keys), 1.0 / (1 << BITS))
        for order in range(1, len(self.grams) + 1):
            gram = keys & ((1 << BITS * order) - 1)
            chance = _find(self.contexts[order - 1], self.backoffs[order - 1], gram >> BITS, 1.0) * chance \
                + _find(self.grams[order - 1], self.shares[order - 1], gram, 0.0)
        return np.log(chance)

    def logs(self) -> np.ndarray:
        """``log_chances`` of every n-gram there can be, worked out once in a task from the sorted arrays.

        The chances of an order are those of the order below, which all first characters share, times
        the weight of the context, plus the share of the n-gram: 2^(ORDER * BITS) numbers.
        """
        if self._logs is None:
            chances = np.full(1, 1.0 / (1 << BITS), np.float32)
            for order, parts in enumerate(zip(self.grams, self.shares, self.contexts, self.backoffs), 1):
                gram, share, context, backoff = parts
                weights = np.ones(1 << BITS * (order - 1), np.float32)
                weights[context] = backoff
                chances = np.tile(chances, 1 << BITS)
                chances.reshape(-1, 1 << BITS)[:] *= weights[:, None]
                chances[gram] += share.astype(np.float32)
            self._logs = np.log(chances)
        return self._logs

    def mean_surprises(self, rows: list[np.ndarray]) -> np.ndarray:
        """Mean negative log chance of the n-grams of each row, its log perplexity; 0 for an empty row."""
        logs = self.logs()
        return np.array([-logs[row].mean(dtype=np.float64) if len(row) else 0.0 for row in rows])

    def __getstate__(self):
        return self.__dict__ | {"_logs": None}


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def fit(counts: DataFrame, order: int = ORDER) -> Model:
    """Modified Kneser-Ney: raw counts at the top order, left continuations below it.

    All counting is Spark's. Discounts of each order come from its counts of counts; the share of
    an n-gram is max(count - discount, 0) over its context's count, and the context's backoff
    weight is what the discounts took away.
    """
    grams, shares, contexts, backoffs = [], [], [], []
    for n in range(order, 0, -1):
        if n < order:
            # Continuations: in how many different n-grams of the order above this one is the tail.
            counts = counts.groupBy((F.col("gram").bitwiseAND((1 << BITS * n) - 1)).alias("gram")).agg(F.count("*").alias("n"))
        table = counts.toPandas().sort_values("gram")
        gram, number = table["gram"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
        of = [int((number == i).sum()) for i in range(5)]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        discounts = [0.0] + [float(np.clip(i - (i + 1) * y * of[i + 1] / of[i], 0.05, i - 0.05)) if of[i] and of[i + 1] else min(0.75, i / 2)
                             for i in (1, 2, 3)]
        cut = np.array(discounts)[np.minimum(number, 3)]
        context, place = np.unique(gram >> BITS, return_inverse=True)
        whole = np.bincount(place, number, len(context))
        grams.append(gram)
        shares.append((number - cut) / whole[place] if len(gram) else np.empty(0))
        contexts.append(context)
        backoffs.append(np.bincount(place, cut, len(context)) / whole)
    return Model(grams[::-1], shares[::-1], contexts[::-1], backoffs[::-1])


def score(docs: DataFrame, shared: Broadcast, key: str = "doc_id", text: str = "text", lang: str = "lang",
          base: bool = True) -> DataFrame:
    """(key, lang, base counts, log_perplexity) of every row under a broadcast model.

    Without ``base``, of the base counts only the number of words is given.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")[:5 if base else 1]
    rows = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch)
            counts = np.array([base_counts(t) if base else (len(split_words(t)),) for t in found], np.int64).reshape(-1, len(names))
            perplexity = np.concatenate([np.empty(0), *[shared.value.mean_surprises(rows) for _, rows in stretches(found)]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("lang"), *[pa.array(c) for c in counts.T],
                 pa.array(perplexity, pa.float64())], ["key", "lang", *names, "log_perplexity"])

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, lang string, " + ", ".join(f"{n} long" for n in names) + ", log_perplexity double"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def bands(scored: DataFrame, band: float = BAND) -> DataFrame:
    """(lang, low, high): median of the log perplexity plus and minus a number of robust deviations.

    A deviation is ``LEAST_SPREAD`` at least.

    Taken over all documents with words of a language, from their counts in small steps, so a
    language with most of the corpus is a few thousand rows. Null is a language of its own.
    """
    step = F.round(F.col("log_perplexity") * STEPS).cast("long")
    steps = scored.where("n_words > 0").groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))
    middle = steps.groupBy("lang").agg(F.percentile("step", F.lit(0.5), F.col("n")).alias("middle"))
    far = steps.join(middle.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    spread = far.groupBy("lang", "middle").agg(
        F.percentile(F.abs(F.col("step") - F.col("middle")), F.lit(0.5), F.col("n")).alias("spread"))
    reach = F.lit(band) * F.greatest(1.4826 * F.col("spread") / STEPS, F.lit(LEAST_SPREAD))
    return spread.select("lang", (F.col("middle") / STEPS - reach).alias("low"), (F.col("middle") / STEPS + reach).alias("high"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          band: float = BAND, length: float = LENGTH) -> DataFrame:
    """(key, base counts, base_failed, log_perplexity, kept) of every row of ``docs``.

    A first model is counted over all texts. The second, which judges, is counted over those that
    pass the base rules and lie in narrower bands of the first, so frequent junk does not teach the
    model that junk is likely. A document is kept unless a base rule fails (fewer than ten words,
    or more than a fifth of the words in repeated windows) or its perplexity is outside its
    language's band, which is wider for a short text. A null text has no words.
    """
    path = new_path(docs.sparkSession, "ngrams")
    share = docs.sparkSession.sparkContext.broadcast
    first = share(fit(store(count_ngrams(docs, text), f"{path}/counts-1")))
    # Only the perplexity is read here, so the base counts are left to the second scoring.
    before = store(score(docs, first, key, text, lang, base=False).drop(key), f"{path}/scored-1")
    limits = store(bands(before, INNER_BAND), f"{path}/bands-1").withColumnRenamed("lang", "_lang")
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    model = share(fit(store(count_ngrams(rows, "text", first), f"{path}/counts-2")))
    scored = store(score(docs, model, key, text, lang), f"{path}/scored-2")
    limits = store(bands(scored, band), f"{path}/bands-2").withColumnRenamed("lang", "_lang")
    judged = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn(
        "base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    more = F.lit(length) / F.sqrt(F.greatest("n_words", F.lit(1)))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low") - more, F.col("high") + more), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop("lang", "_lang", "low", "high")
