"""SimHash, line runs, graphs of embeddings and components."""
from odd_tables import no_docs, odd_docs  # noqa: F401
import random

import numpy as np
import pytest
import xxhash
from conftest import plan_of

from plaudit.llm import components, hnsw, line_dedup, simhash
from plaudit.scratch import scratch


def reach(nodes, links):
    links = list(links)
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 299), (299, 298), (298, 300), (7, 7)]
    expected = reach({n for link in links for n in link}, links)
    with scratch(spark, "test") as path:
        got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a LONG, b LONG"), path).collect()}
        assert got == expected
    with scratch(spark, "test") as path:
        assert components.components(spark.createDataFrame([], "a LONG, b LONG"), path).count() == 0


def test_forest_keeps_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    child, root = components.forest(a, b)
    assert reach(range(200), zip(a.tolist(), b.tolist())) == reach(range(200), zip(child.tolist(), root.tolist()))


@pytest.mark.parametrize("text", ["", "one", "One two", "a b c d c d e", " ".join(map(str, range(300)))])
def test_fingerprint(text):
    words = text.lower().encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == expected


@pytest.mark.parametrize("tile_rows", [2048, 20])
def test_links_agree_with_brute_force_also_in_cut_buckets(spark, tile_rows):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    rows = set(seeds.tolist())
    for seed in [*seeds.tolist()] * 3 + [seeds.tolist()[0]] * 80:  # one large group of near copies
        value = seed
        for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
            value ^= 1 << bit
        rows.add(value)
    rows = np.array(sorted(rows), np.uint64)
    signed = rows.view(np.int64).tolist()
    links = [(signed[i], signed[j]) for i in range(len(rows)) for j in range(i)
             if int(rows[i] ^ rows[j]).bit_count() <= 3]
    with scratch(spark, "test") as path:
        prints = spark.createDataFrame([(v,) for v in signed], "fp LONG")
        got = [tuple(r) for r in simhash.near_links(prints, path, tile_rows=tile_rows).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1) for a, b in got)
    assert reach(signed, got) == reach(signed, links)


def test_simhash_on_odd_and_empty_tables(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[5].component_id == 4 and by_id[3].component_id == by_id[2].component_id == 1
    assert by_id[1].fingerprint == "0" * 16
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns or set(kept.columns) == set(odd_docs.columns)
    assert sorted(r.doc_id for r in kept.where("doc_id < 6").collect()) == [1, 4]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def test_near_copies_with_a_few_edits_are_found(spark):
    rng = random.Random(11)
    rows = []
    for group in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((100 * group, " ".join(words)))
        for copy in range(1, 4):  # each edit changes 5 of 196 shingles; 4 edits leave more than 0.8
            edited = list(words)
            for place in rng.sample(range(10, 190, 10), 4):
                edited[place] = f"new{copy}x{place}"
            rows.append((100 * group + copy, " ".join(edited)))
        half = words[:100] + [f"other{i}" for i in range(100)]  # shares about a third
        rows.append((100 * group + 50, " ".join(half)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    sets = {i: set(simhash.shingle_set(t.encode()).tolist()) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    expected = sorted(set(reach(sets, links).values()))
    assert len(expected) == 40
    parts = {}
    for row in simhash.near_copies(docs).collect():
        parts.setdefault(row.part, []).append(row.key)
    assert sorted(map(min, parts.values())) == expected


def test_near_copies_that_only_meet_over_a_third_text_are_one_group(spark):
    base = [f"w{i}" for i in range(400)]
    chain = [base[40 * i:] + [f"t{j}" for j in range(40 * i)] for i in range(4)]  # neighbours share more than 0.8, ends do not
    chain = [" ".join(words) for words in chain]
    docs = spark.createDataFrame(list(zip((3, 1, 2, 4), chain)), "doc_id LONG, text STRING")
    assert len({r.part for r in simhash.near_copies(docs).collect()}) == 1


def test_one_document_of_each_simhash_component_stays(spark):
    rng = random.Random(13)
    rows = []
    for group in range(30):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 60, 900]))]
        for copy in range(6):
            edited = list(words)
            for place in rng.sample(range(len(words)), copy % 3):
                edited[place] = f"x{rng.randrange(9)}"
            rows.append((group * 10 + copy, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    prints = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    links = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3]
    expected = sorted(set(reach(prints, links).values()))
    assert 30 < len(expected) < len(rows) - 30
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == expected


def test_near_copies_with_null_and_repeated_keys_are_judged_row_by_row(spark):
    rng = random.Random(12)
    one, two, three = (" ".join(f"w{rng.randrange(5000)}" for _ in range(50)) for _ in range(3))
    rows = [(1, one), (2, one), (2, two), (2, two), (None, three), (None, one), (None, two), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, one), (2, two), (None, three), (7, "")], key=str)


def test_repeated_lines_stay_in_the_largest_document_only(odd_docs, no_docs):
    found = {r.doc_id: r for r in line_dedup.drop_repeated_lines(odd_docs).collect()}
    assert {i: found[i].n_dropped for i in range(20, 28)} == {**{i: 1 for i in range(20, 27)}, 27: 0}
    assert found[20].n_lines == 3 and found[20].text.count("\n") == 1 and "passage" not in found[20].text.lower()
    assert found[1].text == "" and found[1].n_lines == 1
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0


def test_repeated_rows_lose_their_own_lines_once(spark):
    line = "This line is long enough to be found in every one of them."
    rows = [(i, f"{line}\nown {i}\n {line.upper()}") for i in range(6)] + [(0, f"{line}\nown 0\n {line.upper()}"), (None, line), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "'x' AS _drop", "'y' AS _key", "'z' AS n_lines")
    found = line_dedup.drop_repeated_lines(docs).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in found if r.doc_id is not None) == sorted(
        [(0, 3, 2)] * 2 + [(i, 3, 2) for i in range(1, 5)] + [(5, 3, 0)])
    assert [(r.text, r.n_dropped) for r in found if r.doc_id is None] == [("", 1)] * 2
    assert all((r._drop, r._key) == ("x", "y") for r in found)


def test_line_runs_are_compacted_and_answers_do_not_depend_on_batches(spark, odd_docs):
    expected = None
    for batches, fan_in in ((1, 2), (3, 2), (7, 3)):
        rows = line_dedup.drop_repeated_lines(odd_docs, batches=batches, fan_in=fan_in).select("doc_id", "text", "n_dropped")
        rows = sorted(map(str, rows.collect()))
        assert expected is None or rows == expected
        expected = rows
    with scratch(spark, "test") as path:
        runs = line_dedup.LineRuns(spark, path)
        for i in range(5):
            fresh = runs.admit(spark.createDataFrame([(b"same", i), (b"new%d" % i, i)], "hash BINARY, key LONG"))
            assert fresh.count() == (2 if i == 0 else 1)
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        assert {bytes(r.hash): (r.docs, r.last) for r in runs.totals().collect()}[b"same"] == (5, 4)


def test_line_dedup_needs_no_python(odd_docs):
    assert "Python" not in plan_of(line_dedup.drop_repeated_lines(odd_docs)) and "Arrow" not in plan_of(line_dedup.drop_repeated_lines(odd_docs))


@pytest.mark.parametrize("shard_rows", [6000, 60])
def test_embeddings_agree_with_brute_force(spark, shard_rows):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(scale=0.03, size=16)).tolist(), 1) for i in range(150)]
    rows += [(200 + i, rng.normal(size=16).tolist(), 1) for i in range(100)]
    rows += [(400 + i, rows[i][1], 2) for i in range(3)] + [(500 + i, rows[0][1], 1) for i in range(20)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [None] * 16, 1), (905, [], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT").selectExpr("*", "1 AS node", "2 AS copies")
    got = {r.vec_id: r for r in hnsw.near_duplicates(frame, shard_rows=shard_rows).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[r[0]].n_links == 0 and got[r[0]].kept for r in odd)
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    labels = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    assert {i: got[i].n_links for i in ids} == dict(zip(ids, near.sum(axis=1).tolist()))
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))]
    assert {i: got[i].component_id for i in ids} == reach(ids, links)
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_a_narrow_beam_is_widened_until_the_audit_passes(monkeypatch):
    monkeypatch.setattr(hnsw, "BEAM", 1)
    rng = np.random.default_rng(5)
    vectors = hnsw._unit(np.concatenate([rng.normal(size=(300, 24)), np.zeros((0, 24))]))
    vectors = hnsw._unit(np.concatenate([vectors, vectors + rng.normal(scale=0.01, size=vectors.shape)]))
    found = hnsw._matches(hnsw.Graph.build(vectors), vectors, vectors, 0.98)
    exact = vectors @ vectors.T >= 0.98
    assert (found & exact).sum() >= 0.97 * exact.sum() and not (found & ~exact).any()


def test_no_link_is_lost_where_links_are_few():
    rng = np.random.default_rng(6)
    left, right = hnsw._unit(rng.normal(size=(1200, 64))), rng.normal(size=(1200, 64))
    planted = rng.choice(1200, 100, replace=False)
    right[planted] = left[planted[::-1]] + rng.normal(scale=0.012, size=(100, 64))
    right = hnsw._unit(right)
    exact = left @ right.T >= 0.98
    assert 60 < exact.sum() < hnsw.AUDIT_LINKS
    assert (hnsw._matches(hnsw.Graph.build(right), left, right, 0.98) == exact).all()


def test_an_audit_leaves_out_the_match_with_itself():
    vectors = hnsw._unit(np.random.default_rng(7).normal(size=(500, 32)))
    audited, truth = hnsw._audit(vectors, vectors, 0.98, same=True)
    assert len(audited) == 500 and not truth.any()
    audited, truth = hnsw._audit(vectors, np.repeat(vectors[:1], 300, axis=0), -1.0, same=False)
    assert len(audited) == 256 and truth.all()
