"""Keyword and facet searches, polarity samples and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaudit.operators import joins, search, summary, words
from plaudit.plans import bindings as b
from plaudit.plans.files import DOC_TERMS, review_payloads
from plaudit.plans.registry import query
from plaudit.scratch import new_path
from plaudit.sinks.tables import write_table
from plaudit.sources import payloads

KEY = "of the"
MIN_BRAND_LINES = 2400


@query("keyword_filter", f"SELECT * FROM documents WHERE regexp_matches(text, '{KEY}')")
def keyword_filter(spark, sf_dir):
    return search.keyword_filter(b.documents(spark, sf_dir), KEY, "text")


@query("facet_filter", b.with_views(b.V_REVIEWS, body="""
SELECT * FROM v_reviews WHERE age = 'en' AND skinType = 'Oily'"""))
def facet_filter(spark, sf_dir):
    return search.facet_filter(b.reviews(spark, sf_dir), b.DOMAINS, age="en", skinType="Oily")


@query("keyword_facet_search", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body=f"""
SELECT * FROM v_products JOIN v_reviews ON ID = productID
WHERE regexp_matches(review, '{KEY}') AND age = 'en'"""))
def keyword_facet_search(spark, sf_dir):
    return search.search(b.reviews(spark, sf_dir), b.products(spark, sf_dir), KEY, b.DOMAINS, age="en")


@query("joined_table_search", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body=f"""
SELECT * FROM v_products JOIN v_reviews ON ID = productID
WHERE regexp_matches(review, '{KEY}') AND age = 'en' AND skinType = 'Oily'"""))
def joined_table_search(spark, sf_dir):
    """The search on a stored join, laid out by the facet that is asked for most."""
    path = new_path(spark, "joined")
    write_table(joins.join_product_review(b.products(spark, sf_dir), b.reviews(spark, sf_dir)), path, "age")
    return search.search_reviews(
        spark.read.parquet(path), KEY, b.DOMAINS, age="en", skinType="Oily")


@query("polarity_sample", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body="""
SELECT rating, review FROM v_products JOIN v_reviews ON ID = productID
WHERE Product_name = 'product src3' AND (rating = '5' OR rating = '1')"""))
def polarity_sample(spark, sf_dir):
    alldata = joins.join_product_review(b.products(spark, sf_dir), b.reviews(spark, sf_dir))
    return search.polarity_sample(alldata, "product src3")


@query("term_presence", b.with_views(DOC_TERMS, body="""
SELECT doc_id AS index, n AS the FROM doc_terms WHERE term = 'the'"""))
def term_presence(spark, sf_dir):
    docs = words.tokenize(b.documents(spark, sf_dir), "text")
    # Only the wanted word is counted; on a stored table the filter on the term does the same.
    wanted = F.filter("tokens", lambda token: token == "the")
    return words.term_presence(words.term_counts(docs, "doc_id", wanted), "doc_id", "the")


@query("customer_slice", b.with_views(b.V_REVIEWS, body="""
SELECT fileIndex, rating FROM v_reviews WHERE age = 'en' AND skinType = 'Oily'"""))
def customer_slice(spark, sf_dir):
    return search.customer_slice(b.reviews(spark, sf_dir), age="en", skinType="Oily")


@query("rating_to_int", b.with_views(b.V_REVIEWS, body="""
SELECT fileIndex, coalesce(rating, 'NA') AS rating, TRY_CAST(rating AS INTEGER) AS rating_int
FROM v_reviews"""))
def rating_to_int(spark, sf_dir):
    rated = search.null_to_missing(b.reviews(spark, sf_dir).select("fileIndex", "rating"), "rating")
    return search.rating_to_int(rated)


@query("polarity_split", b.with_views(b.V_REVIEWS, body="""
SELECT fileIndex, rating, review, CASE rating WHEN '5' THEN 'pos' ELSE 'neg' END AS polarity
FROM v_reviews WHERE rating IN ('5', '1')"""))
def polarity_split(spark, sf_dir):
    return search.polarity_split(b.reviews(spark, sf_dir).select("fileIndex", "rating", "review"))


@query("scatter_points", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body=f"""
SELECT Brand_name, rating, review FROM v_products JOIN v_reviews ON ID = productID
WHERE regexp_matches(review, '{KEY}')"""))
def scatter_points(spark, sf_dir):
    return search.scatter_points(
        search.search(b.reviews(spark, sf_dir), b.products(spark, sf_dir), KEY))


@query("missing_to_null", b.with_views(b.V_REVIEWS, body="""
SELECT concat('user', fileIndex) AS userNickname, rating, age, CAST(NULL AS VARCHAR) AS eyeColor,
       skinType, review FROM v_reviews"""))
def missing_to_null(spark, sf_dir):
    flat = payloads.flatten_review_payload(review_payloads(spark, sf_dir)).select(
        "userNickname", "rating", "age", "eyeColor", "skinType", "review")
    return search.missing_to_null(flat, *flat.columns)


@query("join_product_review", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body="""
SELECT * FROM v_products JOIN v_reviews ON ID = productID"""))
def join_product_review(spark, sf_dir):
    return joins.join_product_review(b.products(spark, sf_dir), b.reviews(spark, sf_dir))


@query("join_part_lineitem", "SELECT * FROM part JOIN lineitem ON p_partkey = l_partkey")
def join_part_lineitem(spark, sf_dir):
    return joins.join_product_review(
        b.table(spark, sf_dir, "part"), b.table(spark, sf_dir, "lineitem"), "p_partkey", "l_partkey")


FREQUENT = f"""
frequent AS (
  SELECT Brand_name FROM v_ratings WHERE Brand_name IS NOT NULL
  GROUP BY Brand_name HAVING count(fileIndex) > {MIN_BRAND_LINES})"""


def frequent_brand_rows(spark, sf_dir):
    rows, products = b.line_reviews(spark, sf_dir), b.line_products(spark, sf_dir)
    brands = summary.product_tally(rows, products, "Brand_name")
    alldata = joins.join_product_review(products, rows)
    return joins.join_frequent_brands(alldata, brands, MIN_BRAND_LINES)


@query("join_frequent_brands", b.with_views(b.V_RATINGS, FREQUENT, body="""
SELECT fileIndex, Brand_name, rating FROM v_ratings
WHERE Brand_name IN (SELECT Brand_name FROM frequent)"""))
def join_frequent_brands(spark, sf_dir):
    return frequent_brand_rows(spark, sf_dir).select("fileIndex", "Brand_name", "rating")


@query("distinct_brands", b.with_views(b.V_RATINGS, FREQUENT, body="""
SELECT DISTINCT Brand_name FROM v_ratings
WHERE Brand_name IN (SELECT Brand_name FROM frequent)"""))
def distinct_brands(spark, sf_dir):
    return summary.distinct_brands(frequent_brand_rows(spark, sf_dir))
