"""Spelling variants, WARC archives and filter interactions against brute force."""
from odd_tables import no_docs, odd_docs  # noqa: F401
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from plaudit.llm import interactions, variants, warc
from plaudit.scratch import scratch

SPACE = re.compile("[^\x20\x09-\x0D]+")


# Spelling variants

def edits(word, letters):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + j:] for i in range(len(word) + 1) for c in letters for j in (0, 1) if i + j <= len(word)}
    return out - {word}


def brute_variants(counts, times=2):
    letters = sorted({c for w in counts for c in w})
    near = {w: edits(w, letters) & counts.keys() for w in counts}
    form = {}
    for word, found in near.items():
        best = min(found, key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best and counts[best] >= times * counts[word] else None

    def root(word):
        return root(form[word]) if form[word] else word
    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


@pytest.mark.parametrize("frequent,longest", [(0, 4), (3, 4), (64, 4), (10**9, 4), (2, 5), (0, 3)])
def test_words_one_edit_apart_share_a_key(frequent, longest, monkeypatch):
    monkeypatch.setattr(variants, "LONGEST", longest)
    rnd = random.Random(frequent + longest)
    words = ["".join(rnd.choice("abà") for _ in range(rnd.randint(1, 14))) for _ in range(300)] + ["a" * n for n in range(1, 20)]
    grams = Counter(s[i:i + n] for w in set(words) for s in [variants.START + w + variants.STOP]
                    for n in range(2, longest) for i in range(len(s) - n + 1))
    extended = {g: n for g, n in grams.items() if n > frequent}
    keys = {w: variants.unaffected(w, extended) for w in set(words)}
    for word in keys:
        for other in edits(word, "abà") & keys.keys():
            if len(word) == len(other):
                assert keys[word][0] & keys[other][0]
            elif len(word) > len(other):
                assert keys[word][0] & keys[other][1]


@pytest.mark.parametrize("long", [64, 8])
def test_variants_agree_with_brute_force(spark, long, monkeypatch):
    monkeypatch.setattr(variants, "near_words", lambda w, p, f, near=variants.near_words: near(w, p, f, long))
    rnd = random.Random(5)
    counts = {}
    for _ in range(400):
        word = "".join(rnd.choice(["an", "ti", "on", "e", "é", "÷", "thr"]) for _ in range(rnd.randint(2, 5)))
        counts[word] = rnd.randint(3, 60)
        for other in rnd.sample(sorted(edits(word, "ae")), 2):
            counts[other] = rnd.randint(3, 30)
    counts |= {"abcde": 100, "abcdx": 50, "abcyx": 25, "abzyx": 12, "tie" * 40: 9, "tie" * 40 + "x": 30, "same1": 8, "same2": 8, "same3": 4}
    words = spark.createDataFrame(list(counts.items()), "word STRING, n LONG").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(words, frequent=5).collect()}
    assert got == brute_variants(counts)
    assert got["abzyx"][1] == "abcde" and got["same3"][0] == "same1" and got["same1"][0] is None


def test_words_of_texts_and_their_noise(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 7, 12345678901, *range(300)]), " ".join(rnd.choice(["Grüße!", "naïve", "WORD-word", "letters", "ÀÉ÷zz", "abcd", *[c * 6 for c in "abcdefghijklm"]])
             for _ in range(rnd.randint(0, 30))) or None) for _ in range(400)]
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    for least in (1, 3):
        expected = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
        assert {r.word: r.n for r in variants.count_words(docs, min_count=least).collect()} == expected
        assert least == 3 or len(expected) > 18


def test_variants_on_odd_and_empty_tables(odd_docs, no_docs):
    more = odd_docs.union(odd_docs).union(odd_docs)
    found = {r.word: r for r in variants.group_spellings(more).collect()}
    assert found["x" * 50_000].n == 3 and found["x" * 50_000].n_near == 0
    assert all(r.root == w or r.form for w, r in found.items())
    assert variants.group_spellings(no_docs).count() == 0


# WARC archives

def brute_pages(rows):
    out, newest = [], {}
    for key, html in rows:
        if key is not None:
            newest[html] = max(newest.get(html, key), key)
    for key, html in rows:
        body = (html or "").encode()
        older = len(body) >= 1000 and html in newest and (key is None or key < newest[html])
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if older else "response", newest[html] if older else None))
    return sorted(out, key=str)


def odd_pages(spark):
    rnd = random.Random(4)
    bodies = [None, "", "short", "é" * 499 + "x", "é" * 500, "x" * 999, "x" * 1000, "WARC/1.1\r\n\r\n" * 200, "\r\n\r\n" * 400,
              "Content-Length: 5\r\n\r\n" * 100, "\x00\x01\t" * 600] + ["".join(rnd.choice("ab \n") for _ in range(3000)) for _ in range(5)]
    rows = [(i, bodies[rnd.randrange(len(bodies))]) for i in range(200)]
    rows += [(199, rows[199][1]), (199, bodies[7]), (None, bodies[7]), (None, "y" * 2000), (None, "y" * 2000)]
    frame = spark.createDataFrame([(k, None if i % 9 == 0 else f"http://a b/\r\nx: {k}\t?", h) for i, (k, h) in enumerate(rows)],
                                  "page_id LONG, url STRING, html STRING")
    return rows, frame.selectExpr("*", "'x' AS key", "1 AS digest", "2 AS size", "3 AS newest", "4 AS page").repartition(5)


def test_archived_pages_agree_with_brute_force(spark):
    rows, frame = odd_pages(spark)
    got = sorted((tuple(r) for r in warc.archived_pages(frame).collect()), key=str)
    assert got == brute_pages(rows)
    assert warc.archived_pages(frame.limit(0)).count() == 0


def test_string_keys_come_back(spark):
    keys = ["a:b", "", "ü %/", "z\n", None]
    frame = spark.createDataFrame([(k, "u", f"body {k}") for k in keys], "page_id STRING, url STRING, html STRING")
    assert sorted((str(r.page_id) for r in warc.archived_pages(frame).collect())) == sorted(map(str, keys))


def test_normalised_archives_have_one_member_a_record_and_a_true_index(spark, tmp_path):
    rows, frame = odd_pages(spark)
    whole, folder = str(tmp_path / "whole"), str(tmp_path / "members")
    warc.write_archives(warc.page_records(warc.find_revisits(frame.select("page_id", "url", "html"))), whole)
    report = warc.normalise_archives(spark, whole, folder).collect()
    assert sum(r.records for r in report) == len(rows) and all(r.error is None for r in report)
    # The monolithic files are one gzip member each, and hold the same bytes as the members together.
    texts = {}
    for row in report:
        data = open(re.sub("^file:", "", row.path), "rb").read()
        stream = zlib.decompressobj(31)
        text = stream.decompress(data)
        assert stream.eof and not stream.unused_data
        name = row.path.rsplit("/", 1)[1].removesuffix(".txt.gz")
        assert gzip.decompress(open(f"{folder}/{name}.warc.gz", "rb").read()) == text
        texts[name] = text
    index = warc.read_index(spark, folder).collect()
    assert len(index) == len(rows)
    for row in index:
        data = open(re.sub("^file:/*", "/", row.archive), "rb").read()
        member = zlib.decompressobj(31)
        record = member.decompress(data[row.offset:row.offset + row.length])
        assert member.eof and not member.unused_data
        fields = warc.header_fields(record)
        assert fields["warc-record-id"] == row.record_id and record.endswith(b"\r\n\r\n")
    # A second pass over archives that are normal already changes nothing.
    again = str(tmp_path / "again")
    warc.normalise_archives(spark, folder, again)
    plain = warc.read_index(spark, again).drop("archive").collect()
    assert sorted(map(tuple, plain)) == sorted(tuple(r)[1:] for r in index)


def test_broken_archives_give_their_whole_records():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    good = gzip.compress(record * 3)

    def run(data):
        archive, sidecar = io.BytesIO(), io.BytesIO()
        records, error = warc.normalise(io.BytesIO(data), archive, sidecar)
        assert gzip.decompress(archive.getvalue()) == record * records if records else archive.getvalue() == b""
        assert sidecar.getvalue().count(b"\n") == records
        return records, error
    assert run(good) == (3, None) and run(b"") == (0, None) and run(gzip.compress(b"")) == (0, None)
    assert run(gzip.compress(record) * 4) == (4, None)
    assert run(gzip.compress(record * 2 + record[:-8]))[0] == 2 and run(gzip.compress(record * 2 + record[:-8]))[1]
    assert run(gzip.compress(record + b"WARC/1.1\r\nWARC-Type: x\r\n\r\n"))[1] == "a record has no content length"
    noise = np.random.default_rng(1).integers(0, 256, 300_000, np.uint8).tobytes()
    long = record + b"WARC/1.1\r\nContent-Length: 300000\r\n\r\n" + noise + b"\r\n\r\n" + record
    cut = gzip.compress(long)
    archive = io.BytesIO()
    assert warc.normalise(io.BytesIO(cut), archive, io.BytesIO()) == (3, None) and gzip.decompress(archive.getvalue()) == long
    records, error = warc.normalise(io.BytesIO(cut[:len(cut) // 2]), io.BytesIO(), io.BytesIO())
    assert records == 1 and error


# Filter interactions

def brute_audit(rows, labels):
    # A null key has no label.
    good, toxic = ({row[0] for row in labels if row[0] is not None and row[at] == 1} for at in (1, 2))
    smallest = {}
    for key, text, _ in rows:
        if key is not None:
            smallest[text or ""] = min(smallest.get(text or "", key), key)
    judged = []
    for key, text, part in rows:
        text = text or ""
        words = SPACE.findall(text)
        judged.append((key, part or "", {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": key is not None and smallest[text] < key}))
    out, shapley = {}, Counter()
    for part in {j[1] for j in judged}:
        own = [j for j in judged if j[1] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                lost = [j for j in left if j[2][name]]
                left = [j for j in left if not j[2][name]]
                shapley[part, name] += len(lost)
                out[part, order, step] = [
                    len(left), len(lost), sum(j[2][name] for j in own) - len(lost),
                    sum(j[2][name] and sum(j[2].values()) == 1 for j in own),
                    sum(j[0] in good for j in lost), sum(j[0] in toxic for j in lost)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_agrees_with_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(150)] + ["Word", "SHOUT", "#tag", "a|b"]
    pool = [None, "", " \t"] + [" ".join(rnd.choices(vocabulary[:rnd.choice([3, 150, 154])], k=rnd.choice([5, 99, 100, 140]))) for _ in range(60)]
    pool += [" ".join(f"u{j}" for j in range(100 + i)) for i in range(9)] + ["A" * 10 + "b" * 90, "A" * 11 + "b" * 89]
    rows = [(i, rnd.choice(pool), rnd.choice(["en", "fr", None, ""])) for i in range(500)]
    rows += [rows[3], rows[3], (None, rows[5][1], "en"), (None, rows[5][1], "en"), (3, "another text", "xx")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 500, 2)] + [(2, 1, 0), (2, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").selectExpr("*", "'x' AS fails", "1 AS good", "2 AS part", "'k' AS key")
    marks = spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").selectExpr("*", "'x' AS part", "9 AS good")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in interactions.audit_documents(docs.repartition(4), marks).collect()}
    assert got == brute_audit(rows, labels) and len(got) == 4 * 600
    assert interactions.audit_documents(docs.limit(0), marks).count() == 0
    assert interactions.audit_documents(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 0, 0), ("p", 1, 3, 1, 0), ("p", 3, 2, 0, 2)], "part STRING, fails INT, n LONG, good LONG, toxic LONG")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in interactions.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (5, 5, 0, 3, 8), ("XY", 2): (5, 0, 2, 0, 2), ("YX", 1): (8, 2, 0, 0, 2), ("YX", 2): (5, 3, 2, 3, 8)}
    with pytest.raises(ValueError):
        interactions.audit(cells, "")


def test_audit_on_odd_tables(odd_docs, spark):
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    found = interactions.audit_documents(odd_docs, labels)
    assert found.groupBy("part", "filter_order").agg(F.sum("removed") + F.min("kept")).count() == 4 * 120
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    with scratch(spark, "test") as path:
        found.write.parquet(f"{path}/audit")
