import pytest
from conftest import plan_of

from plaudit.operators import joins, report, search, summary
from plaudit.sinks.csv import write_review_csv
from plaudit.sinks.tables import write_table
from plaudit.sources.csv import read_csv_infer


def ids(df):
    return sorted(r.fileIndex for r in df.collect())


def test_keyword_is_a_case_sensitive_regex_anywhere(reviews):
    assert ids(search.keyword_filter(reviews, "dark circle")) == [0, 6]
    assert ids(search.keyword_filter(reviews, "[Dd]ark [Cc]ircle")) == [0, 1, 6]
    assert ids(search.keyword_filter(reviews, "it's")) == [6]


def test_facets(reviews):
    assert ids(search.facet_filter(reviews, age="35-44", eyeColor="Brown")) == [0, 6]
    assert ids(search.facet_filter(reviews, age="35-44", eyeColor=None)) == [0, 1, 6]
    assert ids(search.facet_filter(reviews)) == list(range(7))
    with pytest.raises(ValueError, match="none of"):
        search.facet_filter(reviews, age="36")
    with pytest.raises(ValueError, match="unknown facet"):
        search.facet_filter(reviews, rating="5")


def test_facet_order_does_not_matter(reviews):
    one = search.facet_filter(search.facet_filter(reviews, skinType="Dry"), age="35-44")
    two = search.facet_filter(reviews, age="35-44", skinType="Dry")
    assert ids(one) == ids(two) == [0, 6]


def test_search_joins_products_first(reviews, products):
    found = search.search(reviews, products, "dark circle", age="35-44")
    assert found.columns == products.columns + reviews.columns
    assert ids(found) == [0, 6]
    assert "NestedLoop" not in plan_of(found)


def test_facets_and_columns_reach_the_scan(spark, reviews, products, tmp_path):
    reviews.write.parquet(str(tmp_path / "r"))
    products.write.parquet(str(tmp_path / "p"))
    found = search.search(spark.read.parquet(str(tmp_path / "r")),
                          spark.read.parquet(str(tmp_path / "p")), "circle", skinType="Dry")
    plan = plan_of(found.select("Brand_name", "rating"))
    assert "EqualTo(skinType,Dry)" in plan
    assert "ReadSchema: struct<productID:string,rating:string,skinType:string,review:string>" in plan


def test_polarity(reviews, products):
    alldata = joins.join_product_review(products, reviews)
    sample = search.polarity_sample(alldata, "Glow").collect()
    assert sorted(r.rating for r in sample) == ["1", "5", "5"]
    split = {r.fileIndex: r.polarity for r in search.polarity_split(reviews).collect()}
    assert split == {0: "pos", 1: "neg", 4: "pos", 6: "pos"}


def test_rating_and_missing(reviews):
    rated = {r.fileIndex: r.rating_int for r in search.rating_to_int(reviews).collect()}
    assert rated[2] is None and rated[3] == 3
    counts = search.reject_count(search.rating_to_int(reviews)).collect()[0]
    assert (counts.n_values, counts.n_rejected) == (7, 1)
    nulls = {r.fileIndex: r.userNickname for r in
             search.missing_to_null(reviews, "userNickname").collect()}
    assert nulls[6] is None and nulls[0] == "ann"
    words = {r.fileIndex: r.userNickname for r in
             search.null_to_missing(reviews, "userNickname").collect()}
    assert words[1] == "NA"


def test_scatter_and_slice(reviews, products):
    points = search.scatter_points(joins.join_product_review(products, reviews))
    assert points.columns == ["Brand_name", "rating", "review"] and points.count() == 6
    assert ids(search.customer_slice(reviews, age="35-44", eyeColor="Brown")) == [0, 6]


def test_frequent_brands_are_strictly_above(reviews, products):
    alldata = joins.join_product_review(products, reviews)
    tallied = summary.tally(alldata, "Brand_name")
    assert ids(joins.join_frequent_brands(alldata, tallied, 2)) == list(range(4)) + [5, 6]
    assert ids(joins.join_frequent_brands(alldata, tallied, 3)) == []


def test_hot_product_join_is_split_and_whole(spark):
    """One product holds most reviews and neither side is broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        reviews = spark.range(0, 60000, 1, 8).selectExpr(
            "id AS fileIndex", "if(id % 3 > 0, 'P1', concat('P', id % 500)) AS productID",
            "cast(hash(id) AS string) AS review")
        products = spark.range(500).selectExpr("concat('P', id) AS ID", "concat('B', id % 7) AS Brand_name")
        joined = joins.join_product_review(products, reviews)
        assert len(joined.collect()) == 60000
        assert "SortMergeJoin(skew=true)" in plan_of(joined)
        counts = summary.product_tally(reviews, products, "Brand_name")
        assert sum(r.n_rows for r in counts.collect()) == 60000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_report_holds_every_chart_table(reviews, products):
    tables = report.search_report(reviews, products, "dark circle", age="35-44")
    assert {(r.Brand_name, r.n, r.share) for r in tables["top_brands"].collect()} == {("Alpha", 2, 1.0)}
    assert [(r.Product_name, r.n) for r in tables["top_products"].collect()] == [("Glow", 2)]
    assert [(r.median_rating, r.n) for r in tables["median_rating"].collect()] == [(5.0, 2)]
    assert [(r.q1, r.q3, r.n_outside) for r in tables["rating_box"].collect()] == [(5.0, 5.0, 0)]
    assert tables["rating_density"].count() == 0
    assert tables["points"].count() == 2


def test_joined_table_is_pruned_by_facet(spark, reviews, products, tmp_path):
    path = str(tmp_path / "joined")
    write_table(joins.join_product_review(products, reviews), path, "age")
    stored = spark.read.parquet(path)
    found = search.search_reviews(stored, "dark circle", age="35-44")
    assert ids(found) == [0, 6]
    assert "PartitionFilters: [isnotnull(age" in plan_of(found)
    assert summary.count_by_age(summary.tally(stored, "age")).count() == 4


def test_report_from_a_joined_csv_with_inferred_types(spark, reviews, products, tmp_path):
    path = str(tmp_path / "joined")
    write_review_csv(joins.join_product_review(products, reviews), path)
    stored = read_csv_infer(spark, path)
    found = search.rating_to_int(search.search_reviews(stored, "dark circle", age="35-44"), out="rating")
    tables = report.joined_report(found)
    expected = report.search_report(reviews, products, "dark circle", age="35-44")
    for name, table in tables.items():
        assert table.columns == expected[name].columns
        got = sorted(tuple(map(str, r)) for r in table.collect())
        assert got == sorted(tuple(map(str, r)) for r in expected[name].collect())
