"""Spelling variants: words one edit apart, found by an index of variable-length grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plaudit.scratch import new_path, store

# Fixed values of the query: letters of a run, one run in NOISE loses a letter, least length and
# occurrences of a word, and how much more frequent a form must be.
LETTERS, NOISE, MIN_CHARS, MIN_COUNT, FORM_TIMES = "[A-Za-zÀ-ÿ]+", 97, 5, 3, 2

# Shortest and longest gram. A gram that more than FREQUENT words hold is extended.
SHORTEST, LONGEST, FREQUENT = 2, 4, 64

# The threshold rises with the corpus so that at most this many grams are in the dictionary.
DICTIONARY = 200_000

# Words of this many letters and more stand in the lists by a digest.
LONG = 64

# Odd factors of the key hash.
FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)

# Before the first and after the last letter of a word. No word holds them.
START, STOP = "\x02", "\x03"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE,
                min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all texts, each occurrence counted.

    A word is a run of letters with A-Z lower-cased. If the CRC32 of "<key>:<run>" is a multiple of
    ``noise``, the run loses the letter at CRC32 modulo its length. A null key counts as the empty
    text. Counts are added up in each task before they meet.
    """
    runs = docs.select(
        F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = runs.where(F.char_length("run") >= min_chars).withColumn("hash", F.crc32(F.concat("id", "run").cast("binary")))
    place = F.pmod("hash", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    word = F.when(F.pmod("hash", F.lit(noise)) == 0, cut).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT, limit: int = DICTIONARY) -> dict[str, int]:
    """Grams that are extended, with their counts: held more often than the threshold by the words.

    Counts of all shorter substrings are pruned by frequency: a gram is listed if it occurs more
    than ``frequent`` times, and more than one in ``limit`` of all occurrences, so the dictionary
    has at most ``limit`` entries for any vocabulary and can be sent to the tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                spelled = START + word + STOP
                for size in range(SHORTEST, LONGEST):
                    counts.update([spelled[i:i + size] for i in range(len(spelled) - size + 1)])
                if len(counts) > 1_000_000:
                    yield flush(counts)
        yield flush(counts)

    def flush(counts: Counter[str]) -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])
        counts.clear()
        return found

    total = words.agg(F.sum((F.char_length("word") + 2) * (LONGEST - SHORTEST))).first()[0] or 0
    least = max(frequent, -(-total // limit))
    counts = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {row["gram"]: row["n"] for row in counts.where(F.col("n") > least).collect()}


def boundaries(spelled: str, extended: dict[str, int]) -> list[int]:
    """Where the variable grams of a word start, read from the left, and where the last one ends.

    A gram grows while the dictionary lists it, up to the longest length. So where it ends is told
    by its own letters alone, and an edit moves no boundary before it.
    """
    found, at, size = [0], 0, len(spelled)
    while at < size:
        end = min(at + SHORTEST, size)
        while end < size and end - at < LONGEST and spelled[at:end] in extended:
            end += 1
        found.append(end)
        at = end
    return found


def boundaries_from_right(spelled: str, extended: dict[str, int]) -> list[int]:
    """The same read from the right; an edit moves no boundary behind it. In rising order."""
    found, at = [len(spelled)], len(spelled)
    while at > 0:
        start = max(at - SHORTEST, 0)
        while start > 0 and at - start < LONGEST and spelled[start:at] in extended:
            start -= 1
        found.append(start)
        at = start
    return found[::-1]


def unaffected(word: str, extended: dict[str, int]) -> tuple[set[int], set[int]]:
    """Keys of a word for a letter that is replaced or taken out, and for a letter that is put in.

    An edit at a place affects one gram read from the left and one read from the right, and what
    follows the one or precedes the other. All grams before the first and behind the second stay
    as they are; a hash of them and of the width of the gap between them is the key of the place.
    Two words one edit apart have a key in common: replaced letters of both, or a letter taken out
    of the longer one and put into the shorter one.
    """
    spelled = START + word + STOP
    left, right = boundaries(spelled, extended), boundaries_from_right(spelled, extended)
    before, behind, at = [0] * (len(spelled) + 1), [0] * (len(spelled) + 1), 0
    for place in range(len(spelled) + 1):
        while at + 1 < len(left) and left[at + 1] <= place:
            at += 1
        before[place] = left[at]
    at = len(right) - 1
    for place in range(len(spelled), -1, -1):
        while at and right[at - 1] >= place:
            at -= 1
        behind[place] = right[at]
    heads, tails = _running_hash(spelled), _running_hash(spelled[::-1])[::-1]

    def key(start: int, end: int, width: int) -> int:
        mixed = heads[start] * FACTORS[1] ^ tails[end] * FACTORS[2] ^ width * FACTORS[3]
        return (mixed % (1 << 64)) - (1 << 63)

    out = {key(before[i], behind[i + 1], behind[i + 1] - before[i]) for i in range(1, len(spelled) - 1)}
    put = {key(before[i], behind[i], behind[i] - before[i] + 1) for i in range(1, len(spelled))}
    return out, put


def _running_hash(spelled: str) -> list[int]:
    """A hash of every prefix, the empty one first."""
    found, value = [0], 0
    for char in spelled:
        value = (value * FACTORS[0] + ord(char)) % (1 << 64)
        found.append(value)
    return found


def index(words: DataFrame, extended: dict[str, int], name: str) -> DataFrame:
    """(key, put, name, n): the lists of the gram index, one row for each key of each word.

    ``name`` is the column that stands for a word in its lists: the word, or a digest of it.
    """
    shared = words.sparkSession.sparkContext.broadcast(extended)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, puts, places = [], [], []
            for place, word in enumerate(batch.column("word").to_pylist()):
                for put, found in enumerate(unaffected(word, shared.value)):
                    keys += found
                    puts += [bool(put)] * len(found)
                    places += [place] * len(found)
                if len(keys) > 100_000:
                    yield rows(batch, keys, puts, places)
                    keys, puts, places = [], [], []
            yield rows(batch, keys, puts, places)

    def rows(batch, keys, puts, places) -> pa.RecordBatch:
        at = pa.array(places, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(puts, pa.bool_()), batch.column("name").take(at),
             batch.column("n").take(at)], ["key", "put", "name", "n"])

    kind = words.schema[name].dataType.simpleString()
    named = words.select("word", F.col(name).alias("name"), "n")
    return named.mapInArrow(run, f"key long, put boolean, name {kind}, n long")


def _meetings(listed: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of the rows that meet in a list, each pair of one length in one order."""
    left = listed.where("NOT put").select("key", F.col("name").alias("a"), F.col("n").alias("n_a"))
    right = listed.select("key", "put", F.col("name").alias("b"), F.col("n").alias("n_b"))
    return left.join(right, "key").where("put OR a < b")


def near_words(words: DataFrame, path: str, frequent: int = FREQUENT, long: int = LONG) -> DataFrame:
    """(a, n_a, b, n_b): the pairs of words exactly one edit apart, each pair once.

    The lists of a key are merged by a join on stored rows, so a long list can be split, and each
    meeting is verified by edit distance inside the join: only true pairs leave it. Words of
    ``long`` letters and more are kept out of the lists, which hold their digests; so a very long
    word is not repeated once a letter. Its few meetings are looked up before they are verified.
    """
    extended = gram_dictionary(words, frequent)
    verified = F.levenshtein("a", "b", 1) == 1
    short = words.where(F.char_length("word") <= long)
    met = _meetings(store(index(short, extended, "word"), f"{path}/index"))
    near = met.where((F.abs(F.char_length("a") - F.char_length("b")) <= 1) & verified).select("a", "n_a", "b", "n_b")
    lengthy = store(words.where(F.char_length("word") >= long).withColumn("digest", F.md5("word")), f"{path}/long")
    met = _meetings(store(index(lengthy, extended, "digest"), f"{path}/long-index")).select("a", "b").distinct()
    spelled = [lengthy.select(F.col("digest").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab"]
    more = met.join(spelled[0], "a").join(spelled[1], "b").select(
        F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b").where(verified)
    ordered = near.union(more).select(
        F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    return store(ordered.groupBy("a", "b").agg(F.any_value("n_a").alias("n_a"), F.any_value("n_b").alias("n_b")), f"{path}/pairs")


def roots(forms: DataFrame, path: str) -> DataFrame:
    """(word, root): where each word of ``forms(word, form)`` ends by following forms.

    A form is more frequent than its word, so there is no circle. Each round doubles the number
    of steps taken, and is written, so that a form of very many words can be split by the join.
    """
    at, step = store(forms.select("word", F.col("form").alias("root")), f"{path}/root-0"), 0
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        moved = store(at.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{path}/root-{step}")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, times: int = FORM_TIMES, frequent: int = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words(word, n)``, whose words are distinct.

    Two words are near if one inserted, deleted or replaced code point makes one the other. The
    form of a word is its most frequent near word (ties: the smallest in code-point order) if that
    is at least ``times`` as frequent, else null; the root is the last form that is reached.
    """
    path = new_path(words.sparkSession, "variants")
    words = store(words.select("word", "n"), f"{path}/words")
    pairs = near_words(words, path, frequent)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).union(
        pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    judged = store(words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.less")).alias("form_n")), f"{path}/judged")
    found = roots(judged.where("form IS NOT NULL"), path)
    return judged.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Spelling variants among the words of all texts of ``docs``, with the query's noise.

    A null or empty text has no words, a null key counts as the empty text, repeated rows count
    each, and no word at all gives no row. Words of a single very long run are words like others.
    """
    return spelling_variants(count_words(docs, key, text), **options)
