import glob
import os

import pytest
from pyspark.sql import functions as F

from plaudit import schemas
from plaudit.operators import words
from plaudit.plans import files
from plaudit.scratch import scratch_dir
from plaudit.sinks import csv as csv_sink, review_files as file_sink, terms as term_sink
from plaudit.sources import csv as csv_source, review_files


@pytest.mark.parametrize("files", [1, 4])
def test_result_csv_stays_sorted_and_never_overwrites(spark, tmp_path, files):
    path = str(tmp_path / "out")
    df = spark.range(40).select(F.concat(F.lit('b,"'), F.lpad(F.col("id").cast("string"), 2, "0")).alias("k"), "id").repartition(4)
    csv_sink.write_result_csv(df, path, "k", files=files)
    parts = sorted(glob.glob(path + "/part-*.csv"))
    assert len(parts) == files
    assert [line for part in parts for line in open(part).read().splitlines()] == [f'"b,""{i:02}",{i}' for i in range(40)]
    with pytest.raises(Exception, match="exist"):
        csv_sink.write_result_csv(df, path, "k")


def test_rollover_parts_are_exact(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(25).select(F.col("id").alias("fileIndex"), F.lit("x").alias("review"))
    csv_sink.write_csv_rollover(rows.repartition(5), path, part_rows=10)
    for part, size in ((1, 10), (2, 10), (3, 5)):
        files = glob.glob(f"{path}/part={part}/*.csv")
        assert len(files) == 1
        lines = open(files[0]).read().splitlines()
        first = (part - 1) * 10
        assert lines == ["fileIndex,review"] + [f"{i},x" for i in range(first, first + size)]


def test_review_dirs_round_trip(spark, reviews, tmp_path):
    path = str(tmp_path / "out")
    file_sink.write_review_text_dirs(reviews, path, dir_reviews=3)
    assert sorted(d for d in os.listdir(path) if d.startswith("dir=")) == ["dir=1", "dir=2", "dir=3"]
    back, rejects = review_files.read_review_text_records(spark, path)
    assert rejects.count() == 0
    got = {r.userNickname: r for r in back.collect()}
    assert got["ann"].review == 'dark circle\ngone, "wow"' and got["ann"].dir == "1"
    # A tab inside a review cuts it, as fields are told apart by tabs alone.
    assert got["bob"].review == "a" and got["cy"].review == "NA" and got["cy"].dir == "2"


def test_record_separator_in_a_review_fails(spark, reviews, tmp_path):
    bad = reviews.limit(1).withColumn("review", F.lit("x\x1ey"))
    with pytest.raises(Exception, match="record separator"):
        file_sink.write_review_text_dirs(bad, str(tmp_path / "out"))


def test_review_file_tree(spark, reviews, tmp_path):
    path = str(tmp_path / "out")
    file_sink.write_review_file_tree(reviews, path, "productID", "fileIndex")
    back, rejects = review_files.read_review_text_files(spark, path)
    assert rejects.count() == 0
    rows = {r.file: (r.dir, r.review) for r in back.collect()}
    assert rows["0"] == ("P1", 'dark circle\ngone, "wow"') and len(rows) == 7
    assert set(back.columns) == {"dir", "file", *schemas.REVIEW_FIELDS}


def test_term_store_and_header(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "d LONG, tokens ARRAY<STRING>")
    triples = words.term_counts(docs, "d")
    term_sink.write_term_counts(triples, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(tuple(r) for r in stored.collect()) == [(1, "a", 2), (1, "b", 1), (2, "b", 1)]
    assert tuple(term_sink.term_count_header(stored, "d", "term").collect()[0]) == (2, 2, 3)
    empty = triples.where("n > 9")
    assert tuple(term_sink.term_count_header(empty, "d", "term").collect()[0]) == (0, 0, 0)


def test_csv_reads_what_rollover_wrote(spark, reviews, tmp_path):
    path = str(tmp_path / "out")
    csv_sink.write_csv_rollover(reviews, path, part_rows=4)
    back = csv_source.read_reviews(spark, path + "/part=1")
    assert sorted(r.fileIndex for r in back.collect()) == [0, 1, 2, 3]


def test_converter_leaves_file_names_to_tasks_and_no_tree(spark, tmp_path, monkeypatch):
    """What it stores is not read through a driver's list of the tree; only the parts of its tables are left."""
    docs = [(i, f"text\n{i}", "en", f"src{i % 3}", 6) for i in range(250)] + [(250, None, None, "src1", None)]
    spark.createDataFrame(docs, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, None) for i in range(0, 250, 2)], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    stored, read = [], getattr(files, "store", None)
    monkeypatch.setattr(files, "store", lambda df, path: stored.append(df.inputFiles()) or read(df, path), raising=False)
    found = files.materialize
    monkeypatch.setattr(files, "materialize", lambda df, label: stored.append(df.inputFiles()) or found(df, label))
    old = set(glob.glob(scratch_dir(spark) + "/convert-*"))
    rows = files.convert_review_files(spark, str(tmp_path)).collect()
    assert stored and not [name for names in stored for name in names if name.endswith(".txt")]
    order = sorted(docs, key=lambda d: (d[3], d[0]))
    assert sorted((r.fileIndex, r.part, r.productID, r.review) for r in rows) == [
        (i, i // 100 + 1, d[3], "NA" if d[1] is None else d[1]) for i, d in enumerate(order)]
    left = set(glob.glob(scratch_dir(spark) + "/convert-*")) - old
    assert [os.listdir(path) for path in left] == [["parts"]]
