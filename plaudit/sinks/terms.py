"""Bags of words as sparse triples, and the token dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_term_counts(triples: DataFrame, path: str) -> None:
    """Store (doc, term, n) triples as Parquet."""
    triples.write.parquet(path)


def term_count_header(triples: DataFrame, doc: str, term: str) -> DataFrame:
    """One row: number of documents, distinct terms and entries of a stored bag of words.

    Two plain aggregations, not one with two distinct counts, which would shuffle each entry twice.
    """
    zero = F.lit(0).cast("long")
    docs = triples.groupBy(doc).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("docs"), zero.alias("terms"), F.sum("n").alias("entries"))
    terms = triples.groupBy(term).agg(zero.alias("n")).agg(
        zero.alias("docs"), F.count("*").alias("terms"), F.sum("n").alias("entries"))
    return docs.union(terms).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("docs", "terms", "entries")])


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Store (term, term_id, doc_freq)."""
    dictionary.write.parquet(path)
