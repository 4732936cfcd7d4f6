import random

from pyspark.sql import functions as F

from plaudit.operators import numbering


def test_running_total_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i, rng.randrange(10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a LONG, b LONG, v LONG").repartition(7)
    got = {(r.a, r.b): r.before for r in
           numbering.running_total(df, ["a", "b"], F.col("v"), "before").collect()}
    total = 0
    for a, b, v in sorted(rows):
        assert got[a, b] == total
        total += v


def test_number_reviews_with_one_hot_directory(spark):
    """File numbers span several blocks, and one directory holds most files."""
    names = [(7, i * 131) for i in range(3000)] + [(d, f) for d in (2, 10) for f in (10, 2, 70000)]
    rows = [(str(d), str(f)) for d, f in names]
    df = spark.createDataFrame(rows, "dir STRING, file STRING").repartition(5)
    got = {(int(r.dir), int(r.file)): r.fileIndex for r in numbering.number_reviews(df)[0].collect()}
    assert got == {name: i for i, name in enumerate(sorted(names))}


def test_equal_numbers_are_ordered_by_name(spark):
    df = spark.createDataFrame([("1", "1"), ("1", "01"), ("x", "3")], "dir STRING, file STRING")
    rows = {r.file: r.fileIndex for r in numbering.number_reviews(df)[0].collect()}
    assert rows == {"01": 0, "1": 1}
    assert [tuple(r) for r in numbering.number_reviews(df)[1].collect()] == [("x", "3")]


def test_parts_and_dirs(spark):
    df = spark.range(5).withColumnRenamed("id", "i")
    rows = numbering.assign_output_part(df, "i", 2, 3).orderBy("i").collect()
    assert [(r.part, r.dir) for r in rows] == [(1, 1), (1, 1), (2, 1), (2, 2), (3, 2)]


def test_rows_without_a_number_are_dealt_out_and_groups_stay_whole(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 1000, F.col("id")).alias("i"), F.col("id").alias("v"))
    placed = numbering.place_in_groups(df, "i", 10, "part").withColumn("task", F.spark_partition_id())
    rows = placed.collect()
    assert sorted(r.v for r in rows) == list(range(4000))
    assert len({r.task for r in rows if r.i is None}) > 1
    assert len({(r.part, r.task) for r in rows if r.i is not None}) == 100


def test_numeric_names(spark):
    df = spark.createDataFrame([("10",), ("2",), (".DS_Store",), ("1",)], "name STRING")
    rows = {r.name: r.position for r in numbering.sort_numeric_names(df, "name").collect()}
    assert rows == {"1": 0, "2": 1, "10": 2}


def test_top_k_and_union(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("d", 1)], "k STRING, n LONG")
    assert [r.k for r in numbering.top_k(df, "n", 3, "k").collect()] == ["c", "a", "b"]
    one = spark.createDataFrame([("x",), ("y",)], "w STRING")
    two = spark.createDataFrame([("y",), ("z",)], "w STRING")
    assert sorted(r.w for r in numbering.union_words(one, two).collect()) == ["x", "y", "z"]
