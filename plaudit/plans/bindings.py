"""Review, product and rating tables derived from the supplied test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.sources.tables import read_table

V_REVIEWS = """
v_reviews AS (
  SELECT d.doc_id AS fileIndex, d.source AS productID,
         CASE l.quality WHEN 1 THEN '5' WHEN 0 THEN '1' END AS rating,
         d.lang AS age,
         CASE l.toxic WHEN 1 THEN 'Dry' WHEN 0 THEN 'Oily' END AS skinType,
         d.text AS review
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

V_PRODUCTS = """
v_products AS (
  SELECT DISTINCT source AS ID, concat('product ', source) AS Product_name,
         concat('brand', CAST(CAST(substr(source, 4) AS INT) % 5 AS VARCHAR)) AS Brand_name
  FROM documents)"""

V_RATINGS = """
v_ratings AS (
  SELECT l_orderkey * 10 + l_linenumber AS fileIndex, l_partkey AS productID,
         p_name AS Product_name, p_brand AS Brand_name,
         (l_linenumber - 1) % 5 + 1 AS rating,
         l_returnflag AS skinType, l_linestatus AS age
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

# The closed facet lists that fit the bound values.
DOMAINS = {"age": ("en", "fr", "de", "es"), "skinType": ("Dry", "Oily")}


def with_views(*views: str, body: str) -> str:
    return "WITH " + ",".join(views) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("fileIndex"),
        F.col("source").alias("productID"),
        F.when(F.col("quality") == 1, "5").when(F.col("quality") == 0, "1").alias("rating"),
        F.col("lang").alias("age"),
        F.when(F.col("toxic") == 1, "Dry").when(F.col("toxic") == 0, "Oily").alias("skinType"),
        F.col("text").alias("review"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").select("source").distinct()
    brand = F.expr("CAST(substr(source, 4) AS INT) % 5").cast("string")
    return source.select(
        F.col("source").alias("ID"),
        F.concat(F.lit("product "), "source").alias("Product_name"),
        F.concat(F.lit("brand"), brand).alias("Brand_name"))


def line_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reviews without text; the text column repeats the key, as a non-null text."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fileIndex"),
        F.col("l_partkey").alias("productID"),
        ((F.col("l_linenumber") - 1) % 5 + 1).alias("rating"),
        F.col("l_returnflag").alias("skinType"),
        F.col("l_linestatus").alias("age"),
        F.col("l_linestatus").alias("review"))


def line_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ID"), F.col("p_name").alias("Product_name"),
        F.col("p_brand").alias("Brand_name"))
