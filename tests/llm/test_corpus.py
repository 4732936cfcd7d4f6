"""URL rules, mixing, byte-level BPE, the pipeline and the parity of queries with their SQL."""
from odd_tables import no_docs, odd_docs  # noqa: F401
import hashlib
import random

import parity
import public_tokenizers
import pytest
import tiktoken
from conftest import plan_of
from pyspark.sql import functions as F

import corpus_pipeline
from plaudit.llm import bpe, mixing, queries, url_rules
from plaudit.scratch import scratch

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, duck, name):
    assert parity.compare(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name]) == []


def brute_rule(host, path, rules):
    fit = [(len(h), len(p), -i, h + p, a) for i, (a, h, p) in enumerate(rules)
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, "allow")


def test_url_rules_agree_with_brute_force(spark):
    rnd = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "a.net", "c.b.a.com", "org", "com.evil", "a-b.com"]
    rules = [(rnd.choice(["allow", "block"]), rnd.choice(hosts[:7]), rnd.choice(["/", "/a/", "/a/b/", "/en"])) for _ in range(12)]
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts).upper() if rnd.random() < .2 else rnd.choice(hosts)}{rnd.choice(['', '/', '/a/', '/a/b/c?x=/en', '/en#f', '?q'])}"
            for _ in range(300)] + ["", None, "no scheme", "://", "x://a.com://b", "http://a.com:80/a/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://a.com/")], "page_id LONG, url STRING")
    pages = pages.selectExpr("*", "1 AS key", "2 AS kind", "'z' AS host", "3 AS stack")
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    for row in got:
        rest = row.url.split("://", 1)[1] if row.url and "://" in row.url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        assert (row.host, row.path) == (host, path)
        assert (row.rule, row.verdict) == brute_rule(host, path, rules), row
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0
    plan = plan_of(url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)))
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_mixing_fills_to_the_targets(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" * rnd.randint(0, 30)), rnd.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    got = mixing.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    source = {r[0]: r[2] for r in rows}
    for row in got:
        s = source[row.doc_id]
        sizes[s] = sizes.get(s, 0) + row["size"]
        taken[s] = taken.get(s, 0) + row.taken
        target[s] = row.target
        assert row.taken <= 2 * row["size"] and row.taken % max(1, row["size"]) == 0
    names = ["a", "b", "c", "d", None]
    weight, full, total = dict(zip(names, (3, 1, 2, 3, 1))), set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    for s in names:
        assert target[s] == pytest.approx(2 * sizes[s] if s in full else level * weight[s])
        assert abs(taken[s] - target[s]) <= 15.5
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())


def test_mixing_on_odd_and_empty_tables(odd_docs, no_docs):
    found = mixing.mix(odd_docs).collect()
    assert len(found) == odd_docs.count() and all(r.taken == 0 for r in found if r["size"] == 0)
    mixed = mixing.mixed_documents(odd_docs)
    assert set(mixed.columns) == set(odd_docs.columns) and mixed.count() > 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_mixing_loses_no_row_without_key_or_with_a_repeated_one(spark):
    rows = [(1, "w " * 10, "a"), (1, "v " * 30, "a"), (None, "u " * 20, "a"), (None, "t " * 20, "a"), (5, "s " * 9, "a"), (5, "s " * 9, "a")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").selectExpr("*", "'x' AS copies", "'y' AS _copy")
    mixed = [tuple(r) for r in mixing.mixed_documents(docs).collect()]
    # One source, a half more than its words: every row once at least, some twice.
    assert {r[:3] for r in mixed} == set(rows) and all(r[3:] == ("x", "y") for r in mixed)
    assert abs(sum(len(r[1].split()) for r in mixed) - 1.5 * 98) <= 15
    assert sorted(mixed, key=str) == sorted((tuple(r) for r in mixing.mixed_documents(docs.repartition(3)).collect()), key=str)


def tiktoken_encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_are_those_of_the_library():
    rnd = random.Random(8)
    texts = ["", " ", "   a", "a" * 5000, " " * 3000, "\x1c\x1d a\x85b\u3000\u00a0c", "abab" * 3000, "<|endoftext|>", "Don't I'LL 12345 !!"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(0x2000, 0x3100), rnd.randrange(0x1F300, 0x1F700)]))
                      for _ in range(60)) for _ in range(500)]
    encoder = bpe.Encoder(bpe.read_ranks(PATH), PATTERN)
    got = [[int(i) for part in parts for i in part.split()] for parts in encoder.encode_all(texts)]
    assert got == tiktoken_encoding().encode_ordinary_batch(texts)


def test_long_texts_and_a_full_memory_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 7)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 50)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 5)
    texts = ["the quick brown fox jumps over the lazy dog " * 5, "short", "", "another text of words"]
    encoder = bpe.Encoder(bpe.read_ranks(PATH), PATTERN)
    got = [[int(i) for part in parts for i in part.split()] for parts in encoder.encode_all(texts)]
    assert got == tiktoken_encoding().encode_ordinary_batch(texts)


def test_round_trip_on_odd_and_empty_tables(odd_docs, no_docs):
    coded = bpe.decode(bpe.encode(odd_docs, PATH, PATTERN), PATH, PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded.collect())
    encoding = tiktoken_encoding()
    for row in bpe.digests(odd_docs, PATH, PATTERN).join(odd_docs.select("doc_id", "text"), "doc_id").collect():
        ids = encoding.encode_ordinary(row.text or "")
        assert row.n_tokens == len(ids) and row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.digests(no_docs, PATH, PATTERN).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    with scratch(spark, "test") as path:
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, columns = docs, docs.columns
            stage(spark, docs, sf_dir).write.parquet(f"{path}/{number}")
            docs = spark.read.parquet(f"{path}/{number}")
            if number < 4:
                assert docs.columns == columns
            if number == 0:
                bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0")
                good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").join(before, "doc_id")
                assert docs.join(bad, "doc_id").count() <= 0.1 * bad.count()
                assert docs.join(good.select("doc_id"), "doc_id").count() >= 0.97 * good.count()
            if number == 1:
                assert docs.count() == before.count() and docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
            if number == 2:
                assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
            if number == 3:
                taken = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
                assert docs.count() > 0 and taken <= 2
        texts = {r.doc_id: r.text for r in before.collect()}
        rows = before.count()
        assert docs.count() == rows
        assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in docs.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == rows


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    rows = [(1, "plain words in a row " * 9, "en", "a", 9), (1, "other words that go on here " * 9, "en", "a", 9),
            (None, "no key but a text of its own " * 9, "en", None, 9), (None, "a second one without a key " * 9, None, "a", 9)]
    keyless = spark.createDataFrame(rows, odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    for name, docs in (("odd", odd_docs), ("none", no_docs), ("keyless", keyless)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            with scratch(spark, "test") as path:
                stage(spark, docs, sf_dir).write.parquet(f"{path}/{number}")
                found = spark.read.parquet(f"{path}/{number}")
                assert number == 4 or found.columns == columns
                if name == "none":
                    assert found.count() == 0
                if name == "keyless" and number in (1, 2):
                    assert found.count() == 4
                if name == "odd" and number == 1:
                    assert found.count() == docs.count()


def test_places_of_the_longest_string_fit_into_a_node():
    top = (1 << 31) - 1
    node = bpe._NONE << bpe.PLACE_BITS | top
    assert node < 1 << 63 and node >> bpe.PLACE_BITS == bpe._NONE and node & (1 << bpe.PLACE_BITS) - 1 == top
