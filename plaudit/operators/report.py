"""The tables behind all charts of one search."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plaudit import schemas
from plaudit.operators import search, summary
from plaudit.scratch import materialize

CHART_KEYS = ("Brand_name", "Product_name", "rating")


def chart_tables(tallied: DataFrame, min_reviews: int = 0, k: int = 20) -> dict[str, DataFrame]:
    """Chart tables of a tally by brand, product and rating, which is stored and read again."""
    stored = materialize(tallied, "tally")
    histogram = summary.rating_histogram(stored)
    return {
        "top_brands": summary.top_brands(stored, k),
        "top_products": summary.top_products(stored, k),
        "median_rating": summary.brand_median_rating(histogram, min_reviews),
        "rating_box": summary.brand_rating_box(histogram, min_reviews),
        "violin_stats": summary.brand_rating_violin_stats(histogram),
        "rating_density": summary.brand_rating_density(histogram),
    }


def joined_report(found: DataFrame, min_reviews: int = 0, k: int = 20) -> dict[str, DataFrame]:
    """Chart tables and points of rows that are joined already; the tally reads them once."""
    tables = chart_tables(summary.tally(found, *CHART_KEYS), min_reviews, k)
    return {**tables, "points": search.scatter_points(found)}


def search_report(
    reviews: DataFrame, products: DataFrame, key: str, domains: dict = schemas.FACETS,
    min_reviews: int = 0, k: int = 20, **facets: str | None,
) -> dict[str, DataFrame]:
    """Chart tables and points of the reviews that match a keyword and facets."""
    found = search.search_reviews(reviews, key, domains, **facets)
    tables = chart_tables(summary.product_tally(found, products, *CHART_KEYS), min_reviews, k)
    return {**tables, "points": search.scatter_points(
        search.search(reviews, products, key, domains, **facets))}
