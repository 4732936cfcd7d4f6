"""Headed CSV files with free text: quotes are doubled and newlines stay inside quotes.

Files are read in splits, newlines in texts or not (``records.read_records``), which reads them
twice and stores the records; land them once as Parquet and query that. Where no text holds a
newline, pass ``multi_line=False``: one read is enough then. All columns are parsed at ingest:
which rows count as malformed depends on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from plaudit import schemas
from plaudit.functions.missing import na_to_null
from plaudit.sources.records import parse_records, read_records

QUOTING = {"quote": '"', "escape": '"'}
# A null value that no field has keeps an empty quoted text apart from a missing field.
FIELDS = {**QUOTING, "nullValue": "\0"}
READING = {**FIELDS, "header": True}


def read_csv_drop_malformed(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True,
) -> DataFrame:
    """Read with a declared schema and drop rows that do not fit it; the first record of each file is its header.

    The reader skips column pruning, so the same rows are dropped whatever a query selects. A
    line end inside quotes is kept as it stands in the file.
    """
    if multi_line:
        return parse_records(read_records(spark, path).where("NOT header"), schema, **FIELDS)
    return (spark.read.schema(schema).options(**READING, multiLine=multi_line)
            .option("mode", "DROPMALFORMED").option("columnPruning", False).csv(path))


def read_reviews(
    spark: SparkSession, path: str, row_label: str | None = None, multi_line: bool = True,
) -> DataFrame:
    """Reviews with ``NA`` turned into null.

    ``row_label`` names an extra first column, as a table tool leaves it in front of the fields.
    """
    label = [] if row_label is None else [T.StructField(row_label, T.LongType())]
    rows = read_csv_drop_malformed(spark, path, T.StructType([*label, *schemas.REVIEW]), multi_line)
    return rows.select(*[f.name for f in label], "fileIndex",
                       *[na_to_null(c).alias(c) for c in schemas.REVIEW_FIELDS])


def read_products(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    rows = read_csv_drop_malformed(spark, path, schemas.PRODUCT, multi_line)
    return rows.select(*[na_to_null(c).alias(c) for c in schemas.PRODUCT.names])


def read_brand_urls(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_csv_drop_malformed(spark, path, schemas.BRAND_URL, multi_line)


def read_csv_infer(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read with types inferred from the data; costs one more pass over the file."""
    return spark.read.options(**READING, multiLine=multi_line).option("inferSchema", True).csv(path)


def read_polarity_sheet(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A two-column sheet: its first row is a header, whatever it says, and is dropped.

    The header is found by its place, so a large sheet is read in splits. A row with one field
    has a null review.
    """
    if multi_line:
        return parse_records(read_records(spark, path).where("NOT header"), schemas.POLARITY_SAMPLE, False, **FIELDS)
    return (spark.read.schema(schemas.POLARITY_SAMPLE).options(**READING)
            .option("enforceSchema", True).csv(path))
