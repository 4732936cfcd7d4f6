"""A training corpus in five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm import bpe, line_dedup, mixing, ranking, simhash
from plaudit.llm.common import remainder
from plaudit.scratch import new_path, store

VOCABULARY = "byte_bpe_50k.tiktoken"

# The stages hold learned scores, fingerprints and token ids, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality model, learned from the labels, accepts.

    Every row is scored by its own text, whatever its key; a null text counts as empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    return ranking.keep_good(docs, ranking.train(docs, labels))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across them; ``n_chars`` follows the text.

    A null text becomes the empty text; rows without a key count as one document.
    """
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints of 3-word shingles link at 3 or fewer bits."""
    return simhash.drop_near_duplicates(docs, words=3, radius=3)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, row by row, as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the token ids, and the digest of the text decoded from them."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("line dedup", repeated_lines), ("simhash near-dedup", near_duplicates),
          ("mixing sources", mixture), ("byte-level bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = store(stage(spark, docs, sf_dir), f"{path}/{number}")
    return docs
