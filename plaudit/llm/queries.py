"""The operators as named queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaudit.llm import (bpe, hnsw, interactions, lattice, line_dedup, mixing, ngram_quality, ranking, simhash,
                         toxicity, url_rules, variants, warc)
from plaudit.llm.common import remainder
from plaudit.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Vocabulary of the scoring and the encoding query; any file of the same form will do.
VOCABULARY = "byte_bpe_50k.tiktoken"


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _training(spark: SparkSession, sf_dir: str, divisor: int, held: int) -> DataFrame:
    return _table(spark, sf_dir, "labels").where(remainder("doc_id", divisor) != held)


@_query
def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lattice.score_texts(docs, bpe.read_ranks(public_tokenizers.path(VOCABULARY)))


@_query
def op2_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.judge(_table(spark, sf_dir, "documents"))


@_query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ranking.train(docs, _training(spark, sf_dir, 5, 0))
    return ranking.score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= ranking.CUT).cast("int").alias("predicted"))


@_query
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.rule_table(spark, url_rules.RULES)
    return url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op5_url_rules"] = r"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
hosts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '(?s)^[^/?#]*', 0),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (
  SELECT *, host = 'com' OR ends_with(host, '.com') AS com,
         host = 'net' OR ends_with(host, '.net') AS net,
         host = 'example.com' OR ends_with(host, '.example.com') AS example,
         host = 'www.example.com' OR ends_with(host, '.www.example.com') AS www FROM hosts)
SELECT page_id, host, path,
       CASE WHEN www AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN example AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN com AND starts_with(path, '/') THEN 'com/'
            WHEN net AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN net AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule,
       CASE WHEN www AND starts_with(path, '/en/') THEN 'allow'
            WHEN example AND starts_with(path, '/en/') THEN 'block'
            WHEN net AND (starts_with(path, '/es/') OR starts_with(path, '/fr/')) THEN 'block'
            ELSE 'allow' END AS verdict
FROM fits
"""


@_query
def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op6_line_runs"] = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS dropped FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@_query
def op7_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op8_embedding_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, _training(spark, sf_dir, 3, 1))
    return toxicity.score(docs, lexicon).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@_query
def op11_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_spellings(_table(spark, sf_dir, "documents"))


# CRC32 byte by byte from its table; near words share what is left of them without one letter.
ORACLES["op11_gram_variants"] = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS parts),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
met AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(
    string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)] ELSE [192 | (ord(ch) >> 6), 128 | (ord(ch) & 63)] END)),
    lambda c, b: xor(c >> 8, parts[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM met, crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word,
         CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
cuts AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top,
         arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word),
judged AS (
  SELECT w.word, CASE WHEN top >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk(word, reached, form) AS (
  SELECT word, word, form FROM judged
  UNION ALL SELECT w.word, w.form, j.form FROM walk w JOIN judged j ON w.form = j.word)
SELECT j.word, j.form, w.reached AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN walk w ON j.word = w.word AND w.form IS NULL
"""


@_query
def op12_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


ORACLES["op12_warc_members"] = r"""
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
newest AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS newest FROM bodies)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN newest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest > page_id THEN newest END AS refers_to
FROM newest
"""


@_query
def op13_filter_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLES["op13_filter_tensor"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
judged AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(words) < 100 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' END) AS fails FROM docs),
marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[:step - 1] AS before, filter_order[step] AS own
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (translate(fails, before || own, '') = fails) AS kept,
    sum(n) FILTER (translate(fails, before, '') = fails AND contains(fails, own)) AS removed,
    sum(n) FILTER (translate(fails, before, '') <> fails AND contains(fails, own)) AS redundant,
    sum(n) FILTER (fails = own) AS unique_fails,
    sum(good) FILTER (translate(fails, before, '') = fails AND contains(fails, own)) AS good_lost,
    sum(toxic) FILTER (translate(fails, before, '') = fails AND contains(fails, own)) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM counted
"""
