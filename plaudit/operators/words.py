"""Tokens, word frequencies, dictionaries and bags of words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaudit.functions import stopwords, tokens as tok
from plaudit.functions.stem import stem, stem_tokens
from plaudit.operators.numbering import dense_index
from plaudit.operators.search import polarity_split
from plaudit.scratch import materialize


# Buckets in which the words of a class are ranked first.
RANK_BUCKETS = 64


def tokenize(df: DataFrame, text: str = "review", out: str = "tokens") -> DataFrame:
    """Lower-cased word tokens of each text, in order."""
    return df.withColumn(out, tok.words(text))


def remove_stop_words(
    df: DataFrame, stop_words: Iterable[str] | None = None, tokens: str = "tokens",
) -> DataFrame:
    """Drop stop words from the token arrays; repeats of other tokens stay."""
    listed = stopwords.merged() if stop_words is None else list(stop_words)
    return df.withColumn(tokens, tok.without_stop_words(tokens, listed))


def stem_vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct tokens with their stems."""
    vocabulary = _exploded(df, F.col(tokens), "term").distinct()
    return vocabulary.withColumn("stem", stem("term"))


def review_tokens(reviews: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """Tokenise, drop stop words and stem the positive and the negative reviews in one pass.

    Nothing is shuffled: every step works on the token array inside the review's own row.
    """
    cleaned = remove_stop_words(tokenize(polarity_split(reviews)), stop_words)
    return cleaned.select("fileIndex", "polarity", stem_tokens("tokens").alias("tokens"))


def _exploded(df: DataFrame, values: Column, name: str, *kept: str) -> DataFrame:
    # The outer form, because the inner one repeats the array expression in an inferred filter.
    return (df.select(*kept, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull()))


def rank_by_count(counts: DataFrame, word: str, k: int, *by: str) -> DataFrame:
    # The k first of every (class, hash bucket), then of those: no task sees a class's whole
    # vocabulary, whatever k is, and the plan is the same for every k.
    first = [F.desc("n"), F.col(word)]
    near = Window.partitionBy(*by, "_bucket").orderBy(*first)
    cut = counts.withColumn("_bucket", F.pmod(F.hash(word), F.lit(RANK_BUCKETS))).withColumn(
        "rank", F.row_number().over(near)).where(F.col("rank") <= k).drop("_bucket")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*first))).where(F.col("rank") <= k)


def word_frequency(
    reviews: DataFrame, k: int = 30, stop_words: Iterable[str] = stopwords.TOOLKIT,
) -> DataFrame:
    """The ``k`` most frequent alphabetic words per polarity."""
    words = _exploded(polarity_split(reviews), tok.without_stop_words(
        tok.alphabetic_words("review"), stop_words), "word", "polarity")
    counts = words.groupBy("polarity", "word").agg(F.count("*").alias("n"))
    return rank_by_count(counts, "word", k, "polarity")


def cloud_weights(
    reviews: DataFrame, k: int = 200, stop_words: Iterable[str] = stopwords.CLOUD,
) -> DataFrame:
    """Word-cloud weights per polarity: count over the largest count, for the ``k`` top words."""
    words = _exploded(polarity_split(reviews), tok.without_stop_words(
        tok.words("review"), stop_words), "word", "polarity")
    counts = words.groupBy("polarity", "word").agg(F.count("*").alias("n"))
    top = rank_by_count(counts, "word", k, "polarity")
    largest = F.max("n").over(Window.partitionBy("polarity"))
    return top.select("polarity", "word", "n", F.round(F.col("n") / largest, 9).alias("weight"))


def term_counts(df: DataFrame, doc: str, tokens: str | Column = "tokens") -> DataFrame:
    """Sparse (document, term, n) triples. Documents are counted inside their row, unshuffled."""
    values = F.col(tokens) if isinstance(tokens, str) else tokens
    return (df.select(doc, F.explode_outer(tok.bag(values)).alias("_t")).where("_t IS NOT NULL")
            .select(doc, "_t.term", "_t.n"))


def dictionary(triples: DataFrame, doc: str) -> DataFrame:
    """Term ids in order of (first document, term), with document frequency.

    The vocabulary may be large, so ids come from a range-partitioned prefix sum, not one task.
    """
    vocabulary = triples.groupBy("term").agg(
        F.min(doc).alias("first_doc"), F.count("*").alias("doc_freq"))
    return (dense_index(vocabulary, ["first_doc", "term"], "term_id")
            .select("term", "term_id", "doc_freq"))


def bag_of_words(
    df: DataFrame, doc: str, tokens: str | Column = "tokens",
) -> tuple[DataFrame, DataFrame]:
    """The (triples with term ids, dictionary) of a corpus.

    The triples are stored once, so the texts are tokenised once. The stored dictionary is
    broadcast if it is small; otherwise the join shuffles, with skewed terms split at run time.
    """
    triples = materialize(term_counts(df, doc, tokens), "term-counts")
    terms = materialize(dictionary(triples, doc), "dictionary")
    return triples.join(terms.select("term", "term_id"), "term").select(
        doc, "term_id", "term", "n"), terms


def term_presence(triples: DataFrame, doc: str, word: str) -> DataFrame:
    """Documents that hold a word, with its count."""
    return triples.where(F.col("term") == word).select(
        F.col(doc).alias("index"), F.col("n").alias(word))


def term_document_matrix(
    df: DataFrame, doc: str, words: Sequence[str], tokens: str | Column = "tokens",
) -> DataFrame:
    """One row per document with the count of each chosen word; 0 where it does not occur.

    Counted inside each row, so even a document without any of the words keeps its row.
    """
    values = F.col(tokens) if isinstance(tokens, str) else tokens
    chosen = df.select(doc, F.filter(values, lambda t: t.isin(list(words))).alias("_chosen"))

    def count(word: str) -> Column:
        return F.size(F.filter("_chosen", lambda t: t == word)).cast("long").alias(word)

    return chosen.select(doc, *[count(word) for word in words])
