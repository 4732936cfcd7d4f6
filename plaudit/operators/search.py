"""Keyword and facet search, polarity samples, and the row filters around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plaudit import schemas
from plaudit.functions.missing import na_to_null, null_to_na
from plaudit.operators.joins import join_product_review

# The ratings that count as positive and negative.
POSITIVE, NEGATIVE = "5", "1"


def keyword_filter(df: DataFrame, key: str, column: str = "review") -> DataFrame:
    """Rows whose text has a match of the regular expression: anywhere, case counts."""
    return df.where(F.col(column).rlike(key))


def facet_filter(df: DataFrame, domains: dict = schemas.FACETS, **wanted: str | None) -> DataFrame:
    """Rows that equal every given facet; an unset facet sets no condition.

    A facet or value outside its closed list is an error before anything runs. Each condition is
    a plain equality, which reaches the Parquet scan.
    """
    for facet, value in wanted.items():
        if facet not in domains:
            raise ValueError(f"unknown facet {facet!r}; known: {', '.join(domains)}")
        if value is None:
            continue
        if value not in domains[facet]:
            raise ValueError(f"{facet}={value!r} is none of {', '.join(domains[facet])}")
        df = df.where(F.col(facet) == F.lit(value))
    return df


def search_reviews(
    reviews: DataFrame, key: str, domains: dict = schemas.FACETS, **facets: str | None,
) -> DataFrame:
    """Reviews that match the keyword and all given facets."""
    return keyword_filter(facet_filter(reviews, domains, **facets), key)


def search(
    reviews: DataFrame, products: DataFrame, key: str, domains: dict = schemas.FACETS,
    **facets: str | None,
) -> DataFrame:
    """All product and review columns of the matching reviews; they are filtered before the join."""
    return join_product_review(products, search_reviews(reviews, key, domains, **facets))


def polarity_sample(alldata: DataFrame, product_name: str) -> DataFrame:
    """Rating and text of one product's best and worst rated reviews."""
    return (alldata.where((F.col("Product_name") == product_name)
                          & F.col("rating").isin(POSITIVE, NEGATIVE))
            .select("rating", "review"))


def polarity_split(df: DataFrame) -> DataFrame:
    """Label reviews ``pos`` or ``neg`` by rating in one pass and drop the others."""
    label = F.when(F.col("rating") == POSITIVE, "pos").when(F.col("rating") == NEGATIVE, "neg")
    return df.where(F.col("rating").isin(POSITIVE, NEGATIVE)).withColumn("polarity", label)


def customer_slice(df: DataFrame, **facets: str) -> DataFrame:
    """Index and rating of the reviews written by customers with the given facets."""
    for facet, value in facets.items():
        df = df.where(F.col(facet) == F.lit(value))
    return df.select("fileIndex", "rating")


def rating_to_int(df: DataFrame, column: str = "rating", out: str = "rating_int") -> DataFrame:
    """Rating as an integer, null where it is not one."""
    return df.withColumn(out, F.col(column).try_cast("int"))


def reject_count(df: DataFrame, column: str = "rating", parsed: str = "rating_int") -> DataFrame:
    """One row: values that are there, and those of them that did not parse."""
    return df.agg(F.count(column).alias("n_values"),
                  F.count_if(F.col(column).isNotNull() & F.col(parsed).isNull()).alias("n_rejected"))


def scatter_points(result: DataFrame) -> DataFrame:
    """The rows behind a scatter chart of ratings by brand."""
    return result.select("Brand_name", "rating", "review")


def missing_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """The word ``NA`` becomes null in the given text columns."""
    return df.withColumns({c: na_to_null(c) for c in columns})


def null_to_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Null becomes the word ``NA`` in the given text columns."""
    return df.withColumns({c: null_to_na(c) for c in columns})
