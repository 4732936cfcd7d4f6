import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from conftest import plan_of
from hypothesis import given, settings, strategies as st

from plaudit.functions import stopwords, tokens as tok
from plaudit.functions.stem import stem, stem_tokens, stem_word
from plaudit.operators import words
from plaudit.plans import stem_sql

# Word pairs of the published sample vocabulary.
PAIRS = """
consign consign consigned consign consigning consign consignment consign consist consist
consistency consist consistently consist consolation consol consolatory consolatori console consol
consolidate consolid consolingly consol consonant conson consort consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspiring conspir constable
constabl constance constanc constancy constanc constant constant knackeries knackeri knaves knave
knavish knavish kneading knead knightly knight knives knive knocker knocker knocking knock knotted
knot skies sky dying die gently gentl news news generate generat generically generic communism
communism arsenal arsenal say say by by enjoyed enjoy hopping hop hoped hope ties tie cries cri gas
gas kiwis kiwi agreed agre relational relat rationalize ration hopefulness hope adoption adopt
luxuriated luxuri proceeded proceed sensibly sensibl apologies apolog happy happi
""".split()


@pytest.mark.parametrize("word,expected", list(zip(PAIRS[::2], PAIRS[1::2])))
def test_published_stems(word, expected):
    assert stem_word(word) == expected


@given(st.text(alphabet="aeioubdglnstyzé'", min_size=1, max_size=14))
@settings(max_examples=300, deadline=None)
def test_stem_is_never_longer_than_the_word_plus_one(word):
    assert 0 <= len(stem_word(word)) <= len(word) + 1


def test_stem_udf_keeps_order_nulls_and_empty_arrays(spark):
    rows = [(1, ["ponies", "running", "ponies"]), (2, []), (3, None), (4, ["skies"])]
    df = spark.createDataFrame(rows, "d LONG, t ARRAY<STRING>").repartition(2)
    got = {r.d: r.t for r in df.select("d", stem_tokens("t").alias("t")).collect()}
    assert got == {1: ["poni", "run", "poni"], 2: [], 3: None, 4: ["sky"]}
    single = spark.createDataFrame([("ties",), (None,)], "w STRING").select(stem("w").alias("s"))
    assert {r.s for r in single.collect()} == {"tie", None}


def test_tokens_are_unicode_words(spark):
    df = spark.createDataFrame([("Café_2 don't—STOP",), (None,), ("",)], "review STRING")
    assert [r.tokens for r in words.tokenize(df).collect()] == [
        ["café_2", "don", "t", "stop"], [], []]


def test_alphabetic_words(spark):
    df = spark.createDataFrame([("Good, good  GOOD ünd 5stars it's",)], "review STRING")
    assert df.select(tok.alphabetic_words("review").alias("w")).collect()[0].w == [
        "good", "good", "ünd"]


def test_stop_words_keep_repeats(spark):
    df = spark.createDataFrame([(["the", "best", "best", "of", "t"],)], "tokens ARRAY<STRING>")
    assert words.remove_stop_words(df).collect()[0].tokens == ["best", "best"]
    assert (len(stopwords.TOOLKIT), len(stopwords.PLAIN)) == (179, 174)


def test_bag_counts_like_a_counter(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdefé") for _ in range(rng.randrange(40))]) for i in range(200)]
    rows.append((999, None))
    df = spark.createDataFrame(rows, "d LONG, tokens ARRAY<STRING>")
    triples = words.term_counts(df, "d")
    assert "Exchange" not in plan_of(triples)
    got = {}
    for r in triples.collect():
        got.setdefault(r.d, {})[r.term] = r.n
    assert got == {i: dict(Counter(t)) for i, t in rows if t}


@pytest.fixture()
def docs(spark):
    rows = [(3, ["b", "z"]), (1, ["z", "a", "z"]), (2, ["a", "c", "b"])]
    return spark.createDataFrame(rows, "d LONG, tokens ARRAY<STRING>")


def test_dictionary_ids_follow_first_document_then_term(docs):
    rows = words.dictionary(words.term_counts(docs, "d"), "d").collect()
    assert {r.term: (r.term_id, r.doc_freq) for r in rows} == {
        "a": (0, 2), "z": (1, 2), "b": (2, 2), "c": (3, 1)}


def test_bag_of_words(docs):
    bag, terms = words.bag_of_words(docs, "d")
    assert sorted((r.d, r.term_id, r.n) for r in bag.collect()) == [
        (1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 2, 1), (2, 3, 1), (3, 1, 1), (3, 2, 1)]
    assert terms.count() == 4


def test_bag_of_words_without_broadcast(spark, docs):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bag, _ = words.bag_of_words(docs, "d")
        assert "SortMergeJoin" in plan_of(bag) and bag.count() == 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_term_matrix_and_presence(docs):
    wide = {r.d: (r.z, r.q) for r in words.term_document_matrix(docs, "d", ["z", "q"]).collect()}
    assert wide == {1: (2, 0), 2: (0, 0), 3: (1, 0)}
    has = words.term_presence(words.term_counts(docs, "d"), "d", "z").collect()
    assert sorted((r["index"], r["z"]) for r in has) == [(1, 2), (3, 1)]


def test_frequency_and_cloud_per_polarity(spark):
    rows = [(1, "5", "Love love it, the love"), (2, "5", "blush blush"), (3, "1", "blush broke"),
            (4, "3", "ignored ignored"), (5, "1", None)]
    reviews = spark.createDataFrame(rows, "fileIndex LONG, rating STRING, review STRING")
    freq = [(r.polarity, r["rank"], r.word, r.n) for r in words.word_frequency(reviews, k=2).collect()]
    assert sorted(freq) == [("neg", 1, "blush", 1), ("neg", 2, "broke", 1),
                            ("pos", 1, "love", 3), ("pos", 2, "blush", 2)]
    assert "WindowGroupLimit" in plan_of(words.word_frequency(reviews))
    cloud = {(r.polarity, r.word): r.weight for r in words.cloud_weights(reviews).collect()}
    assert cloud["pos", "love"] == 1 and cloud["pos", "blush"] == pytest.approx(2 / 3, abs=1e-8)
    assert ("pos", "the") not in cloud and ("pos", "it") not in cloud


def test_words_between_spaces_of_every_script(spark):
    df = spark.createDataFrame([(1, "5", "red\u00a0lips\u3000red\u2003glow")], "fileIndex LONG, rating STRING, review STRING")
    assert {r.word: r.n for r in words.word_frequency(df, stop_words=[]).collect()} == {"red": 2, "lips": 1, "glow": 1}


def test_large_and_small_k_agree(spark):
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2500))
    df = spark.createDataFrame([(1, "5", text), (2, "1", text)], "fileIndex LONG, rating STRING, review STRING")
    many = words.word_frequency(df, k=2000, stop_words=[]).collect()
    assert len(many) == 4000 and max(r["rank"] for r in many) == 2000
    few = words.word_frequency(df, k=3, stop_words=[]).collect()
    assert sorted(few) == sorted(r for r in many if r["rank"] <= 3)


def test_review_tokens_need_no_shuffle(spark):
    rows = [(1, "5", "The ponies were running"), (2, "1", "Skies!"), (3, "4", "no")]
    reviews = spark.createDataFrame(rows, "fileIndex LONG, rating STRING, review STRING")
    tokens = words.review_tokens(reviews)
    assert "Exchange" not in plan_of(tokens)
    assert {r.fileIndex: (r.polarity, r.tokens) for r in tokens.collect()} == {
        1: ("pos", ["poni", "run"]), 2: ("neg", ["sky"])}


def test_stemmer_agrees_with_its_sql_on_made_up_words():
    """Two separate statements of the algorithm, on words made of every suffix it knows."""
    rng = random.Random(11)
    endings = [s for group in (stem_sql.STEP_2, stem_sql.STEP_3, stem_sql.STEP_4) for s, _ in group]
    endings += ["ogi", "li", "ative", "ion", "sses", "ied", "ies", "us", "ss", "s", "eed", "eedly", "ed",
                "edly", "ing", "ingly", "at", "bl", "iz", "e", "ll", "y", ""]
    starts = ["gener", "commun", "arsen", "y", "inn", "proc", "exc", ""]
    made = set()
    while len(made) < 20000:
        body = "".join(rng.choice("aeiouybdglnstwxéz") for _ in range(rng.randrange(5)))
        word = rng.choice(starts) + body + rng.choice(endings) + rng.choice(endings)
        if word:
            made.add(word)
    made |= {"skis", "dying", "idly", "only", "news", "innings", "herring", "proceed", "succeeds"}
    con = duckdb.connect()
    con.execute("CREATE TABLE vocabulary (term VARCHAR)")
    con.executemany("INSERT INTO vocabulary VALUES (?)", [(w,) for w in sorted(made)])
    expected = dict(con.execute(f"WITH {stem_sql.STEMS} SELECT term, stem FROM stems").fetchall())
    assert len(expected) == len(made)
    assert [(w, stem_word(w), s) for w, s in expected.items() if stem_word(w) != s] == []


def test_bag_of_words_with_a_hot_term_is_split_and_whole(spark):
    """A term of every document, and a dictionary that is not broadcast."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    old = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        docs = spark.range(0, 30000, 1, 8).selectExpr(
            "id AS d", "array('hot', concat('w', id % 3000)) AS tokens")
        bag, terms = words.bag_of_words(docs, "d")
        rows = bag.collect()
        assert len(rows) == 60000 and terms.count() == 3001
        assert "SortMergeJoin(skew=true)" in plan_of(bag)
        ids = {r.term: r.term_id for r in rows}
        assert ids["hot"] == 0 and ids["w0"] == 1 and ids["w2999"] == 3000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stems_kept_by_a_task_are_bounded(monkeypatch):
    from plaudit.functions import stem
    monkeypatch.setattr(stem, "SLICE_WORDS", 30)
    monkeypatch.setattr(stem, "KNOWN_WORDS", 100)
    known, most = {}, []
    plain = stem.stem_word
    monkeypatch.setattr(stem, "stem_word", lambda word: most.append(len(known)) or plain(word))
    listed = [f"run{chr(97 + i % 26)}{chr(97 + i // 26)}ing" for i in range(500)] * 2
    stems = stem._stem_distinct(pa.array([*listed, None, ""]), known)
    assert stems.to_pylist() == [*map(plain, listed), None, ""]
    assert len(known) <= 100 and max(most) < 100
    assert stem._stem_distinct(pa.array([], pa.string()), known).to_pylist() == []
