"""Counts by facet, brand and product, and the tables behind the rating charts."""

from __future__ import annotations

from plaudit.operators import search, summary
from plaudit.plans import bindings as b
from plaudit.plans.registry import query
from plaudit.plans.searches import KEY, MIN_BRAND_LINES

FLAGS = ("A", "N", "R")


def line_tally(spark, sf_dir, *by):
    return summary.product_tally(b.line_reviews(spark, sf_dir), b.line_products(spark, sf_dir), *by)


def line_histogram(spark, sf_dir):
    return summary.rating_histogram(line_tally(spark, sf_dir, "Brand_name", "rating"))


@query("count_by_age", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body="""
SELECT age, count(*) AS n FROM v_products JOIN v_reviews ON ID = productID GROUP BY age"""))
def count_by_age(spark, sf_dir):
    return summary.count_by_age(summary.product_tally(
        b.reviews(spark, sf_dir), b.products(spark, sf_dir), "age"))


@query("count_by_skin_type", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body="""
SELECT skinType, count(*) AS n FROM v_products JOIN v_reviews ON ID = productID GROUP BY skinType"""))
def count_by_skin_type(spark, sf_dir):
    return summary.count_by_skin_type(summary.product_tally(
        b.reviews(spark, sf_dir), b.products(spark, sf_dir), "skinType"))


@query("brand_popularity", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body="""
SELECT Brand_name, count(review) AS n FROM v_products JOIN v_reviews ON ID = productID
GROUP BY Brand_name"""))
def brand_popularity(spark, sf_dir):
    return summary.brand_popularity(summary.product_tally(
        b.reviews(spark, sf_dir), b.products(spark, sf_dir), "Brand_name"))


def _product_counts(name: str, flag: str) -> None:
    @query(name, b.with_views(b.V_RATINGS, body=f"""
SELECT Product_name, count(age) AS n FROM v_ratings WHERE skinType = '{flag}' GROUP BY Product_name"""))
    def product_counts(spark, sf_dir):
        rows = b.line_reviews(spark, sf_dir).where(f"skinType = '{flag}'")
        tallied = summary.product_tally(
            rows, b.line_products(spark, sf_dir), "Product_name", "skinType")
        return summary.product_counts(tallied, flag)


_product_counts("product_counts_dry", "A")
_product_counts("product_counts_normal", "N")
_product_counts("product_counts_oily", "R")


@query("product_counts_combination", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body="""
SELECT Product_name, count(review) AS n FROM v_products JOIN v_reviews ON ID = productID
WHERE skinType = 'Oily' GROUP BY Product_name"""))
def product_counts_combination(spark, sf_dir):
    rows = search.facet_filter(b.reviews(spark, sf_dir), b.DOMAINS, skinType="Oily")
    tallied = summary.product_tally(rows, b.products(spark, sf_dir), "Product_name", "skinType")
    return summary.product_counts(tallied, "Oily")


@query("product_counts_one_pass", b.with_views(b.V_RATINGS, body="SELECT Product_name, " + ", ".join(
    f"count(age) FILTER (skinType = '{f}') AS \"n_{f}\"" for f in FLAGS) + """
FROM v_ratings WHERE skinType IN ('A', 'N', 'R') GROUP BY Product_name"""))
def product_counts_one_pass(spark, sf_dir):
    return summary.product_counts_by_skin_type(
        line_tally(spark, sf_dir, "Product_name", "skinType"), FLAGS)


def top_sql(keys: str) -> str:
    return b.with_views(b.V_RATINGS, body=f"""
SELECT {keys}, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM (
  SELECT {keys}, count(fileIndex) AS n FROM v_ratings GROUP BY {keys}
  ORDER BY n DESC, {keys} LIMIT 20)""")


@query("top_brands", top_sql("Brand_name"))
def top_brands(spark, sf_dir):
    return summary.top_brands(line_tally(spark, sf_dir, "Brand_name"))


@query("top_products", top_sql("Product_name, Brand_name"))
def top_products(spark, sf_dir):
    return summary.top_products(line_tally(spark, sf_dir, "Product_name", "Brand_name"))


@query("search_top_brands", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body=f"""
SELECT Brand_name, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM (
  SELECT Brand_name, count(fileIndex) AS n FROM v_products JOIN v_reviews ON ID = productID
  WHERE regexp_matches(review, '{KEY}') AND age = 'en'
  GROUP BY Brand_name ORDER BY n DESC, Brand_name LIMIT 20)"""))
def search_top_brands(spark, sf_dir):
    found = search.search_reviews(b.reviews(spark, sf_dir), KEY, b.DOMAINS, age="en")
    return summary.top_brands(summary.product_tally(found, b.products(spark, sf_dir), "Brand_name"))


@query("brand_median_rating", b.with_views(b.V_RATINGS, body="""
SELECT Brand_name, CAST(quantile_cont(rating, 0.5) AS DOUBLE) AS median_rating,
       count(fileIndex) AS n
FROM v_ratings GROUP BY Brand_name HAVING count(fileIndex) > 5"""))
def brand_median_rating(spark, sf_dir):
    return summary.brand_median_rating(line_histogram(spark, sf_dir), 5)


@query("brand_rating_box", b.with_views(b.V_RATINGS, """
boxes AS (
  SELECT Brand_name, count(fileIndex) AS n, min(rating) AS min_rating,
         CAST(quantile_cont(rating, 0.25) AS DOUBLE) AS q1,
         CAST(quantile_cont(rating, 0.5) AS DOUBLE) AS median_rating,
         CAST(quantile_cont(rating, 0.75) AS DOUBLE) AS q3, max(rating) AS max_rating
  FROM v_ratings GROUP BY Brand_name HAVING count(fileIndex) > 0)""", """
fences AS (
  SELECT *, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lower_fence,
         q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS upper_fence FROM boxes)""", body="""
SELECT fences.*, (SELECT count(*) FROM v_ratings r WHERE r.Brand_name = fences.Brand_name
                  AND (r.rating < lower_fence OR r.rating > upper_fence)) AS n_outside
FROM fences"""))
def brand_rating_box(spark, sf_dir):
    return summary.brand_rating_box(line_histogram(spark, sf_dir))


@query("brand_rating_violin_stats", b.with_views(b.V_RATINGS, body=f"""
SELECT Brand_name, CAST(quantile_cont(rating, 0.5) AS DOUBLE) AS median_rating
FROM v_ratings GROUP BY Brand_name HAVING count(fileIndex) > {MIN_BRAND_LINES}"""))
def brand_rating_violin_stats(spark, sf_dir):
    return summary.brand_rating_violin_stats(line_histogram(spark, sf_dir), MIN_BRAND_LINES)


@query("brand_rating_density", b.with_views(b.V_RATINGS, """
shaped AS (
  SELECT Brand_name, count(rating) AS n, CAST(min(rating) AS DOUBLE) AS low,
         CAST(max(rating) AS DOUBLE) AS high,
         stddev_samp(rating) * pow(CAST(count(rating) AS DOUBLE), -0.2) AS h
  FROM v_ratings GROUP BY Brand_name HAVING count(fileIndex) > 20 AND min(rating) < max(rating))""",
"""
values_per_brand AS (
  SELECT Brand_name, rating, count(*) AS c FROM v_ratings GROUP BY Brand_name, rating)""", """
points AS (
  SELECT s.*, v.rating, v.c, p.point, low + p.point * ((high - low) / 99) AS x
  FROM shaped s JOIN values_per_brand v ON s.Brand_name = v.Brand_name,
       (SELECT CAST(unnest(range(100)) AS INTEGER) AS point) p)""", body="""
SELECT Brand_name, point, round(min(x), 9) AS x,
       round(sum(CAST(c AS DOUBLE) / n * exp(-0.5 * ((x - rating) / h) * ((x - rating) / h))
                 / (h * sqrt(CAST(2.0 AS DOUBLE) * pi()))), 9) AS density
FROM points GROUP BY Brand_name, point"""))
def brand_rating_density(spark, sf_dir):
    return summary.brand_rating_density(line_histogram(spark, sf_dir))


@query("corpus_size", b.with_views(b.V_REVIEWS, body=r"""
SELECT rating, count(*) AS n_reviews, CAST(sum(length(review)) AS BIGINT) AS n_chars,
       CAST(sum(len(regexp_extract_all(lower(review), '[\p{L}\p{N}_]+'))) AS BIGINT) AS n_words,
       max(len(regexp_extract_all(lower(review), '[\p{L}\p{N}_]+'))) AS max_words
FROM v_reviews GROUP BY rating"""))
def corpus_size(spark, sf_dir):
    return summary.corpus_size(b.reviews(spark, sf_dir), "rating")
