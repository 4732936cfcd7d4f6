import math
import random

import numpy as np
import pytest

from plaudit.operators import topics

THEMES = {
    "eyes": ["lash", "liner", "shadow", "mascara", "brow"],
    "skin": ["serum", "cleanser", "toner", "mask", "moistur"],
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(0)
    rows = [(i, polarity, [rng.choice(words) for _ in range(40)])
            for i in range(120) for polarity in ("pos", "neg")
            for words in [list(THEMES.values())[i % 2]]]
    return spark.createDataFrame(rows, "fileIndex LONG, polarity STRING, tokens ARRAY<STRING>")


@pytest.fixture(scope="module")
def models(docs):
    return topics.lda_topics(docs, k=2, sweeps=20)


def test_planted_topics_are_found(models):
    found = {}
    for r in models.topics(5).collect():
        found.setdefault((r.polarity, r.topic), set()).add(r.term)
    for polarity in ("pos", "neg"):
        assert sorted(sorted(v) for k, v in found.items() if k[0] == polarity) == sorted(map(sorted, THEMES.values()))


def test_every_document_is_in_every_sweep(models):
    assert models.documents == [{"pos": 120, "neg": 120}] * 20


def test_topic_words_shape(models):
    rows = topics.topic_words(models).collect()
    assert len(rows) == 2 * 2 * 5
    for polarity in ("pos", "neg"):
        for topic in (0, 1):
            weights = [r.weight for r in sorted(
                (r for r in rows if r.polarity == polarity and r.topic == topic),
                key=lambda r: r["rank"])]
            assert weights == sorted(weights, reverse=True) and min(weights) > 0


def test_each_topic_is_a_distribution_over_the_whole_vocabulary(models):
    rows = topics.topic_summary(models).collect()
    assert len(rows) == 4
    assert all(r.total_weight == pytest.approx(1) and r.n_terms == 10 and r.min_weight >= 0
               and r.doc_prior > 0 for r in rows)


def test_blocks_change_nothing(docs):
    whole, cut = (topics.lda_topics(docs, k=2, sweeps=3, block_words=words) for words in (10**9, 500))
    rows = [{(r.polarity, r.topic, r.term): r.weight for r in m.weights().collect()} for m in (whole, cut)]
    # Rounds end by the mean change of a block, so the last digits may differ.
    assert rows[0].keys() == rows[1].keys() and all(rows[0][k] == pytest.approx(rows[1][k], abs=5e-3) for k in rows[0])


def test_a_block_agrees_with_documents_one_by_one():
    rng = np.random.default_rng(4)
    weights, prior = np.exp(topics.digamma(rng.gamma(2, 1, (6, 3))) - topics.digamma(np.full(3, 9.0))), np.array([0.3, 0.1, 0.6])
    counts = rng.integers(0, 4, (5, 6))
    counts[:, 0] += 1
    doc, place = np.nonzero(counts)
    uses, logs, documents = topics.expect(doc, place, counts[doc, place].astype(float), weights, prior)
    assert documents == 5 and uses.sum() == pytest.approx(counts.sum())
    total, log_sum = np.zeros((6, 3)), np.zeros(3)
    for row in counts:
        gamma = prior + row.sum() / 3
        for _ in range(300):
            theta = np.exp(topics.digamma(gamma) - topics.digamma(gamma.sum()))
            share = weights * theta / (weights @ theta)[:, None]
            gamma = prior + row @ share
        log_theta = topics.digamma(gamma) - topics.digamma(gamma.sum())
        share = weights * np.exp(log_theta) / (weights @ np.exp(log_theta))[:, None]
        total += row[:, None] * share
        log_sum += log_theta
    assert np.allclose(uses, total, atol=0.02) and np.allclose(logs, log_sum, atol=0.1)


def test_derivatives_of_the_log_gamma_function():
    x, h = np.array([0.01, 0.2, 1.0, 3.5, 80.0]), 1e-5
    slope = np.array([(math.lgamma(v + h * v) - math.lgamma(v - h * v)) / (2 * h * v) for v in x])
    assert np.allclose(topics.digamma(x), slope, rtol=1e-6)
    assert np.allclose(topics.trigamma(x), (topics.digamma(x * (1 + h)) - topics.digamma(x * (1 - h))) / (2 * h * x), rtol=1e-5)


def test_the_learned_prior_is_that_of_drawn_shares():
    rng = np.random.default_rng(2)
    true, prior = np.array([0.2, 1.0, 3.0]), np.full(3, 1 / 3)
    mean_log = np.log(rng.dirichlet(true, 40_000) + 1e-300).mean(axis=0)
    for _ in range(60):
        prior = topics.new_prior(prior, mean_log, 40_000)
    assert np.allclose(prior, true, rtol=0.05)


def test_odd_documents(spark):
    rows = [("pos", ["a", "b", "a"]), ("pos", []), ("pos", None), (None, ["c"]), ("other", ["d"]), ("pos", ["a", None, "e"])]
    model = topics.lda_topics(spark.createDataFrame(rows, "polarity STRING, tokens ARRAY<STRING>"), k=2, sweeps=2)
    assert {r.term for r in model.weights().collect()} == {"a", "b", "e"}
    assert model.documents == [{"pos": 2}] * 2
    empty = topics.lda_topics(spark.createDataFrame([], "polarity STRING, tokens ARRAY<STRING>"), sweeps=2)
    assert topics.topic_words(empty).count() == 0 and topics.topic_summary(empty).count() == 0


def test_terms_of_blocks_travel_as_numbers_of_a_part(docs):
    """One row for a block and a part, and with the parts' terms the documents' counts again."""
    blocks = topics._blocks(docs.where("polarity = 'pos'"), "tokens", "polarity", 3, 4).cache()
    rows = topics._vocabulary(blocks, "polarity").collect()
    named = {r.part: r.terms for r in rows if r.block < 0}
    assert sorted(t for terms in named.values() for t in terms) == sorted(t for words in THEMES.values() for t in words)
    assert len(rows) <= 3 * 4 + 4
    counts = {}
    for r in blocks.where("part < 0").collect():
        own = [named[v.part][i] for v in sorted((v for v in rows if v.block == r.block), key=lambda v: v.part)
               for i in np.frombuffer(v["index"], np.int32)]
        for place, n in zip(np.frombuffer(r.place, np.int32), np.frombuffer(r.n, np.int32)):
            counts[own[place]] = counts.get(own[place], 0) + int(n)
    expected = {}
    for r in docs.where("polarity = 'pos'").collect():
        for t in r.tokens:
            expected[t] = expected.get(t, 0) + 1
    assert counts == expected


def test_shares_go_on_from_the_sweep_before(monkeypatch):
    rng = np.random.default_rng(9)
    doc = np.repeat(np.arange(50, dtype=np.int32), 20)
    place, n = rng.integers(0, 200, 1000).astype(np.int32), rng.integers(1, 4, 1000).astype(float)
    weights, prior = rng.dirichlet(np.full(200, 0.1), 5).T + 1e-9, np.full(5, 0.2)
    monkeypatch.setattr(topics, "ROUNDS", 3000)
    monkeypatch.setattr(topics, "CHANGE", 1e-10)
    uses, logs, gamma = topics.expect_from(doc, place, n, weights, prior)
    monkeypatch.setattr(topics, "STRETCH", 100)
    again, more, _ = topics.expect_from(doc, place, n, weights, prior, gamma)
    assert np.allclose(uses, again, atol=1e-3) and np.allclose(logs, more, atol=1e-3) and uses.sum() == pytest.approx(n.sum())
    monkeypatch.setattr(topics, "ROUNDS", 2)
    assert np.allclose(topics.expect_from(doc, place, n, weights, prior, gamma)[0], again, atol=1e-3)
    assert not np.allclose(topics.expect_from(doc, place, n, weights, prior)[0], again, atol=1e-3)
