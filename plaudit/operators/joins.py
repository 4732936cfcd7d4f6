"""Products to reviews, and the restriction to frequent brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plaudit.scratch import materialize


def join_product_review(
    products: DataFrame, reviews: DataFrame, product_id: str = "ID", review_id: str = "productID",
) -> DataFrame:
    """Inner join, product columns first.

    No hint: a product table below the broadcast threshold is broadcast, a larger one is shuffled,
    and then adaptive execution splits the partition of a product that has a large share of all
    reviews. For counts alone, ``summary.product_tally`` shuffles no review rows at all.
    """
    return products.join(reviews, products[product_id] == reviews[review_id], "inner")


def frequent_brands(tally: DataFrame, min_reviews: int = 20, brand: str = "Brand_name") -> DataFrame:
    """Brands with more than ``min_reviews`` reviews, from a tally."""
    return (tally.where(F.col(brand).isNotNull()).groupBy(brand)
            .agg(F.sum("n_index").alias("n")).where(F.col("n") > min_reviews).select(brand))


def join_frequent_brands(
    result: DataFrame, tally: DataFrame, min_reviews: int = 20, brand: str = "Brand_name",
) -> DataFrame:
    """Rows of the brands that have more than ``min_reviews`` reviews.

    The brand list is stored first: Spark sees its size and broadcasts it, so the rows stay where
    they are, unless the list is too long for that.
    """
    kept = materialize(frequent_brands(tally, min_reviews, brand), "frequent-brands")
    return result.join(kept, brand, "left_semi")
