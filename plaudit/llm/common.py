"""Words, hashed splits and Arrow batches shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: white space between words, as in `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"

# The same as a character class for Java and RE2 patterns.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def remainder(column: str, divisor: int) -> Column:
    """crc32 of a column as text modulo ``divisor``; a null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def row_print(key: str, text: str) -> Column:
    """Names a row by its key and text, also where the key is null or repeated."""
    named = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(named, F.lit("\0"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def split_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: bytes.split() cuts at exactly the six ASCII spaces."""
    return text.split()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; a null is an empty text."""
    return [value or b"" for value in batch.column(column).cast(pa.binary()).to_pylist()]


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    return df.mapInArrow(function, schema)


def sample_labels(labels: DataFrame, column: str, key: str, limit: int) -> DataFrame:
    """At most about ``limit`` labelled keys, chosen by a hash of the key.

    The share is the limit over the number of labelled rows, so the sample is bounded on any
    table and the same on every run. Rows without key or label are not used.
    """
    usable = labels.select(key, F.col(column).cast("int").alias("label")).where(
        f"{key} IS NOT NULL AND label IN (0, 1)")
    total = usable.count()
    share = min(1.0, limit / total) if total else 1.0
    position = F.pmod(F.xxhash64(F.lit("labels"), F.col(key)), F.lit(1 << 30))
    return usable.where(position < F.lit(int(share * (1 << 30)))).dropDuplicates([key])
