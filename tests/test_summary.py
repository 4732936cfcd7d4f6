import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.operators import joins, summary


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_null_groups_and_kinds_of_counts(reviews, products):
    alldata = joins.join_product_review(products, reviews)
    ages = dict(table(summary.count_by_age(summary.tally(alldata, "age")), "age", "n"))
    assert ages == {"35-44": 3, None: 1, "18-24": 1, "over 54": 1}
    types = dict(table(summary.count_by_skin_type(summary.tally(alldata, "skinType")), "skinType", "n"))
    assert sum(ages.values()) == sum(types.values()) == alldata.count()
    brands = dict(table(summary.brand_popularity(summary.tally(alldata, "Brand_name")), "Brand_name", "n"))
    assert brands == {"Alpha": 3, "Beta": 2}  # the null review of Beta is not counted


def test_product_tally_equals_tally_of_the_join(spark, reviews, products):
    doubled = products.union(products.where("ID = 'P1'"))
    by = ("Brand_name", "Product_name", "skinType", "rating")
    whole = summary.tally(joins.join_product_review(doubled, reviews), *by)
    early = summary.product_tally(reviews, doubled, *by)
    columns = (*by, *summary.COUNTS)
    assert table(early, *columns) == table(whole, *columns)


def test_product_counts_one_pass_equals_each(reviews, products):
    tallied = summary.product_tally(reviews, products, "Product_name", "skinType")
    wide = {r.Product_name: r for r in
            summary.product_counts_by_skin_type(tallied, ["Dry", "Oily", "Combination"]).collect()}
    for kind in ("Dry", "Oily", "Combination"):
        single = dict(table(summary.product_counts(tallied, kind), "Product_name", "n"))
        assert {p: r[f"n_{kind}"] for p, r in wide.items() if r[f"n_{kind}"]} == {
            p: n for p, n in single.items() if n}


def test_top_is_repeatable_on_ties_and_shares_add_up(spark):
    rows = [(b, i) for b in "dcba" for i in range(2)] + [("e", 9), (None, 1), (None, 2), (None, 3)]
    df = spark.createDataFrame(rows, "Brand_name STRING, fileIndex LONG").withColumn("review", F.lit("x"))
    top = summary.top_brands(summary.tally(df, "Brand_name"), 3).collect()
    assert [(r.Brand_name, r.n) for r in top] == [("a", 2), ("b", 2), ("c", 2)]
    assert sum(r.share for r in top) == pytest.approx(1, abs=1e-8)
    df = df.withColumn("Product_name", F.lit("p"))
    top = summary.top_products(summary.tally(df, "Brand_name", "Product_name"), 10).collect()
    assert [(r.Product_name, r.Brand_name) for r in top] == [("p", b) for b in "abcde"]


@pytest.fixture()
def rated(spark):
    rng = np.random.default_rng(3)
    rows = [(f"b{b}", str(int(r)), i) for b, size in enumerate((5, 6, 21, 40, 3))
            for i, r in enumerate(rng.integers(1, 6, size))]
    rows += [("b5", "5", i) for i in range(30)] + [("b6", "NA", 0), (None, "5", 1)]
    df = spark.createDataFrame(rows, "Brand_name STRING, rating STRING, fileIndex LONG")
    values = {}
    for brand, rating, _ in rows:
        if brand and rating != "NA":
            values.setdefault(brand, []).append(int(rating))
    return df.withColumn("review", F.lit("x")), values


def test_medians(rated):
    df, values = rated
    histogram = summary.rating_histogram(summary.tally(df, "Brand_name", "rating"))
    rows = summary.brand_median_rating(histogram, 5).collect()
    assert {r.Brand_name: (r.median_rating, r.n) for r in rows} == {
        b: (float(np.median(v)), len(v)) for b, v in values.items() if len(v) > 5}
    medians = [r.median_rating for r in rows]
    assert medians == sorted(medians, reverse=True)
    everyone = summary.brand_median_rating(histogram, 0).collect()
    assert {r.Brand_name: r.n for r in everyone}["b6"] == 1  # counted, without a median
    violin = summary.brand_rating_violin_stats(histogram).collect()
    assert {r.Brand_name for r in violin} == {"b2", "b3", "b5"}


def test_boxes(rated):
    df, values = rated
    histogram = summary.rating_histogram(summary.tally(df, "Brand_name", "rating"))
    for r in summary.brand_rating_box(histogram, 3).collect():
        v = np.array(values[r.Brand_name])
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert (r.n, r.min_rating, r.max_rating) == (len(v), v.min(), v.max())
        assert (r.q1, r.median_rating, r.q3) == (q1, q2, q3)
        assert (r.lower_fence, r.upper_fence) == (low, high)
        assert r.n_outside == int(((v < low) | (v > high)).sum())


def test_density(rated):
    df, values = rated
    histogram = summary.rating_histogram(summary.tally(df, "Brand_name", "rating"))
    rows = summary.brand_rating_density(histogram, 20).collect()
    assert {r.Brand_name for r in rows} == {"b2", "b3"}  # b5 has one rating only
    for r in rows:
        v = np.array(values[r.Brand_name], float)
        h = v.std(ddof=1) * len(v) ** -0.2
        x = v.min() + r.point * (v.max() - v.min()) / 99
        expected = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi))
        assert r.x == pytest.approx(x, abs=1e-8) and r.density == pytest.approx(expected, abs=1e-8)


def test_unrated_reviews_count_towards_the_limit_of_every_chart(spark):
    rows = [(i, "b", float(1 + i % 5), "x") for i in range(20)] + [(20, "b", None, "x")]
    df = spark.createDataFrame(rows, "fileIndex LONG, Brand_name STRING, rating DOUBLE, review STRING")
    histogram = summary.rating_histogram(summary.tally(df, "Brand_name", "rating"))
    assert summary.brand_rating_violin_stats(histogram, 20).count() == 1
    assert summary.brand_rating_density(histogram, 20).select("Brand_name").distinct().count() == 1


def test_corpus_size(reviews):
    sizes = {r.skinType: r for r in summary.corpus_size(reviews, "skinType").collect()}
    dry = sizes["Dry"]
    assert (dry.n_reviews, dry.n_words, dry.max_words) == (3, 9, 5)


def test_distinct_brands(reviews, products):
    rows = summary.distinct_brands(joins.join_product_review(products, reviews)).collect()
    assert sorted(r.Brand_name for r in rows) == ["Alpha", "Beta"]
