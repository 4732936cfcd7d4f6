"""Counts, shares, medians and densities of ratings.

Everything here is computed from a *tally*: one row per group of reviews with

* ``n_rows``     all rows,
* ``n_reviews``  rows with a review text,
* ``n_index``    rows with a file index.

One pass makes the tally; each chart table is a small aggregation of it. Exact medians need only
the count of each rating, so no group of raw rows is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plaudit.functions import tokens as tok
from plaudit.operators.numbering import top_k

BRAND = "Brand_name"
PRODUCT = "Product_name"
COUNTS = ("n_rows", "n_reviews", "n_index")

# Grid points of a density curve.
GRID = 100


def tally(rows: DataFrame, *by: str) -> DataFrame:
    """Group joined rows in one pass, partly on the map side."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count("review").alias("n_reviews"),
        F.count("fileIndex").alias("n_index"))


def product_tally(
    reviews: DataFrame, products: DataFrame, *by: str,
    product_id: str = "ID", review_id: str = "productID",
) -> DataFrame:
    """Tally of ``products inner join reviews`` without joining the reviews.

    Reviews are counted per product and group first. That collapses a product with a third of all
    reviews into a few rows on the map side; only these counts meet the product table.
    """
    facets = [c for c in by if c in reviews.columns]
    counted = tally(reviews, review_id, *facets)
    joined = counted.join(products, counted[review_id] == products[product_id], "inner")
    return joined.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])


def _count_by(tallied: DataFrame, *by: str, counted: str) -> DataFrame:
    return tallied.groupBy(*by).agg(F.sum(counted).alias("n"))


def count_by_age(tallied: DataFrame) -> DataFrame:
    """Rows per age; a missing age is a group of its own."""
    return _count_by(tallied, "age", counted="n_rows")


def count_by_skin_type(tallied: DataFrame) -> DataFrame:
    """Rows per skin type; a missing skin type is a group of its own."""
    return _count_by(tallied, "skinType", counted="n_rows")


def brand_popularity(tallied: DataFrame) -> DataFrame:
    """Reviews with a text per brand."""
    return _count_by(tallied, BRAND, counted="n_reviews")


def product_counts(tallied: DataFrame, skin_type: str) -> DataFrame:
    """Reviews with a text per product, of customers with one skin type."""
    return _count_by(tallied.where(F.col("skinType") == skin_type), PRODUCT, counted="n_reviews")


def product_counts_by_skin_type(tallied: DataFrame, skin_types: Sequence[str]) -> DataFrame:
    """The same for several skin types in one pass, a column for each; 0 where there is none."""
    wanted = tallied.where(F.col("skinType").isin(list(skin_types)))
    return wanted.groupBy(PRODUCT).agg(*[
        F.sum(F.when(F.col("skinType") == s, F.col("n_reviews")).otherwise(0)).alias(f"n_{s}")
        for s in skin_types])


def _top_with_share(tallied: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    known = tallied
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    shown = top_k(_count_by(known, *keys, counted="n_index"), "n", k, *keys)
    # The window spans the k rows that are left.
    total = F.sum("n").over(Window.partitionBy())
    return shown.select(*keys, "n", F.round(F.col("n") / total, 9).alias("share"))


def top_brands(tallied: DataFrame, k: int = 20) -> DataFrame:
    """Most reviewed brands, with their share of the shown total."""
    return _top_with_share(tallied, [BRAND], k)


def top_products(tallied: DataFrame, k: int = 20) -> DataFrame:
    """Most reviewed (product, brand) pairs, with their share of the shown total."""
    return _top_with_share(tallied, [PRODUCT, BRAND], k)


def rating_histogram(tallied: DataFrame) -> DataFrame:
    """Count of each integer rating per brand, without missing brands.

    A rating that is no integer is counted under null: it is a review, but has no value.
    """
    rating = F.col("rating").try_cast("int").alias("rating")
    return (tallied.where(F.col(BRAND).isNotNull()).groupBy(BRAND, rating)
            .agg(F.sum("n_rows").alias("n_rated"), F.sum("n_index").alias("n")))


def brand_median_rating(histogram: DataFrame, min_reviews: int = 0) -> DataFrame:
    """Median rating and review count of brands with more than ``min_reviews`` reviews."""
    return (histogram.groupBy(BRAND)
            .agg(F.percentile("rating", 0.5, F.col("n_rated")).alias("median_rating"),
                 F.sum("n").alias("n"))
            .where(F.col("n") > min_reviews)
            .orderBy(F.desc("median_rating"), BRAND))


def brand_rating_box(histogram: DataFrame, min_reviews: int = 0) -> DataFrame:
    """Box-plot numbers per brand, with fences at 1.5 quartile ranges and the count beyond them.

    The quartiles are put beside the brand's few rating counts, so the tally is read once.
    """
    brand = Window.partitionBy(BRAND)
    quartiles = F.percentile("rating", [0.25, 0.5, 0.75], F.col("n_rated")).over(brand)
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = (histogram.withColumn("_q", quartiles)
              .withColumns({"q1": F.col("_q")[0], "median_rating": F.col("_q")[1],
                            "q3": F.col("_q")[2]})
              .withColumns({"lower_fence": F.col("q1") - spread,
                            "upper_fence": F.col("q3") + spread}))
    outside = ((F.col("rating") < F.col("lower_fence"))
               | (F.col("rating") > F.col("upper_fence")))
    boxes = ("q1", "median_rating", "q3", "lower_fence", "upper_fence")
    return (fenced.groupBy(BRAND)
            .agg(F.sum("n").alias("n"), F.min("rating").alias("min_rating"),
                 F.max("rating").alias("max_rating"), *[F.first(c).alias(c) for c in boxes],
                 F.sum(F.when(outside, F.col("n_rated")).otherwise(0)).alias("n_outside"))
            .where(F.col("n") > min_reviews))


def brand_rating_violin_stats(histogram: DataFrame, min_reviews: int = 20) -> DataFrame:
    """Median rating of the brands with more than ``min_reviews`` reviews."""
    return brand_median_rating(histogram, min_reviews).select(BRAND, "median_rating")


def brand_rating_density(histogram: DataFrame, min_reviews: int = 20) -> DataFrame:
    """Gaussian kernel density of ratings per brand, on a grid from its lowest to its highest.

    The bandwidth is Scott's: sample deviation times n^(-1/5). Brands with one rating value have
    no density and are left out. The sum runs over the counted rating values, not over reviews.
    """
    brand = Window.partitionBy(BRAND)
    n, x = F.col("n_rated").cast("double"), F.col("rating").cast("double")
    # Reviews without a rating count towards the limit, as in the other charts, and nowhere else.
    counted = histogram.withColumn("_reviews", F.sum("n").over(brand)).where(F.col("rating").isNotNull())
    sums = counted.withColumns({
        "_n": F.sum(n).over(brand),
        "_s1": F.sum(n * x).over(brand), "_s2": F.sum(n * x * x).over(brand),
        "_low": F.min(x).over(brand), "_high": F.max(x).over(brand)})
    variance = (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n")) / (F.col("_n") - 1)
    step = (F.col("_high") - F.col("_low")) / (GRID - 1)
    points = (sums.where((F.col("_reviews") > min_reviews) & (F.col("_low") < F.col("_high")))
              .withColumns({"_h": F.sqrt(variance) * F.pow("_n", F.lit(-0.2)),
                            "point": F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))})
              .withColumn("x", F.col("_low") + F.col("point") * step))
    away = (F.col("x") - F.col("rating")) / F.col("_h")
    kernel = F.exp(-0.5 * away * away) / (F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))
    return points.groupBy(BRAND, "point").agg(
        F.round(F.min("x"), 9).alias("x"),
        F.round(F.sum(F.col("n_rated") / F.col("_n") * kernel), 9).alias("density"))


def distinct_brands(rows: DataFrame) -> DataFrame:
    """Brands that occur in the rows."""
    return rows.select(BRAND).distinct()


def corpus_size(rows: DataFrame, *by: str) -> DataFrame:
    """Reviews, characters and words per group, in one pass."""
    measured = rows.select(*by, F.length("review").cast("long").alias("_chars"),
                           F.size(tok.words("review")).cast("long").alias("_words"))
    return measured.groupBy(*by).agg(
        F.count("*").alias("n_reviews"), F.sum("_chars").alias("n_chars"),
        F.sum("_words").alias("n_words"), F.max("_words").alias("max_words"))
