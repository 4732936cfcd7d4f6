"""Tokens, word frequencies, dictionaries, bags of words, stems and topics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from plaudit.functions import stopwords
from plaudit.operators import numbering, topics, words
from plaudit.plans import bindings as b
from plaudit.plans.files import DICTIONARY, DOC_TERMS
from plaudit.plans.registry import query
from plaudit.plans.stem_sql import STEMS
from plaudit.scratch import materialize

CHOSEN_WORDS = ("the", "of", "and", "que", "der")


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


DOC_TOKENS = r"""
doc_tokens AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS tokens FROM documents)"""

POLARITY = """
polar AS (
  SELECT fileIndex, CASE rating WHEN '5' THEN 'pos' ELSE 'neg' END AS polarity, review
  FROM v_reviews WHERE rating IN ('5', '1'))"""


def _listed(df):
    """Token arrays as one text and a size, so that both engines compare the same values."""
    return df.withColumn("n_tokens", F.size("tokens").cast("long")).withColumn(
        "tokens", F.array_join("tokens", " "))


def _tokens(spark, sf_dir):
    return words.tokenize(b.documents(spark, sf_dir).select("doc_id", "text"), "text").drop("text")


@query("tokenize_regex", b.with_views(DOC_TOKENS, body="""
SELECT doc_id, array_to_string(tokens, ' ') AS tokens, len(tokens) AS n_tokens FROM doc_tokens"""))
def tokenize_regex(spark, sf_dir):
    return _listed(_tokens(spark, sf_dir))


@query("remove_stop_words", b.with_views(DOC_TOKENS, f"""
kept AS (
  SELECT doc_id, list_filter(tokens, lambda t: t NOT IN ({sql_list(stopwords.merged())})) AS tokens
  FROM doc_tokens)""", body="""
SELECT doc_id, array_to_string(tokens, ' ') AS tokens, len(tokens) AS n_tokens FROM kept"""))
def remove_stop_words(spark, sf_dir):
    return _listed(words.remove_stop_words(_tokens(spark, sf_dir)))


@query("union_stop_words", b.with_views(DOC_TERMS, body=f"""
SELECT term FROM doc_terms WHERE term IN ({sql_list(stopwords.TOOLKIT)})
UNION SELECT term FROM doc_terms WHERE term IN ({sql_list(stopwords.PLAIN)})"""))
def union_stop_words(spark, sf_dir):
    """The stop words that the documents use, from either list."""
    found = _tokens(spark, sf_dir).select(F.explode_outer("tokens").alias("term"))
    used = materialize(found.where(
        stopwords.is_stop_word(F.col("term"), stopwords.merged())).distinct(), "stop-words-used")
    first = used.where(stopwords.is_stop_word(F.col("term"), stopwords.TOOLKIT))
    second = used.where(stopwords.is_stop_word(F.col("term"), stopwords.PLAIN))
    return numbering.union_words(first, second)


@query("stem_tokens", b.with_views(DOC_TERMS, """
vocabulary AS (SELECT DISTINCT term FROM doc_terms)""", STEMS, body="SELECT term, stem FROM stems"))
def stem_tokens(spark, sf_dir):
    return words.stem_vocabulary(_tokens(spark, sf_dir))


def _review_tokens(spark, sf_dir):
    return words.review_tokens(b.reviews(spark, sf_dir))


@query("review_tokens", b.with_views(b.V_REVIEWS, POLARITY, f"""
placed AS (
  SELECT fileIndex, polarity, unnest(tokens) AS term, unnest(range(len(tokens))) AS place FROM (
    SELECT fileIndex, polarity, list_filter(
      regexp_extract_all(lower(review), '[\\p{{L}}\\p{{N}}_]+'),
      lambda t: t NOT IN ({sql_list(stopwords.merged())})) AS tokens FROM polar))""", """
vocabulary AS (SELECT DISTINCT term FROM placed)""", STEMS, body="""
SELECT polar.fileIndex, polar.polarity, coalesce(string_agg(stem, ' ' ORDER BY place), '') AS tokens,
       count(stem) AS n_tokens
FROM polar LEFT JOIN (placed JOIN stems USING (term)) p ON polar.fileIndex = p.fileIndex
GROUP BY polar.fileIndex, polar.polarity"""))
def review_tokens(spark, sf_dir):
    return _listed(_review_tokens(spark, sf_dir))


@query("word_frequency", b.with_views(b.V_REVIEWS, POLARITY, rf"""
words AS (
  SELECT polarity, unnest(string_split_regex(lower(review), '[\t-\r\x1c-\x20\x85\p{{Z}}]+')) AS word FROM polar)""", rf"""
counts AS (
  SELECT polarity, word, count(*) AS n FROM words
  WHERE regexp_matches(word, '^\p{{L}}+$') AND word NOT IN ({sql_list(stopwords.TOOLKIT)})
  GROUP BY polarity, word)""", body="""
SELECT polarity, word, n, CAST(row_number() OVER (PARTITION BY polarity ORDER BY n DESC, word) AS INT)
       AS rank FROM counts QUALIFY rank <= 30"""))
def word_frequency(spark, sf_dir):
    return words.word_frequency(b.reviews(spark, sf_dir))


@query("cloud_weights", b.with_views(b.V_REVIEWS, POLARITY, r"""
words AS (
  SELECT polarity, unnest(regexp_extract_all(lower(review), '[\p{L}\p{N}_]+')) AS word
  FROM polar)""", f"""
counts AS (
  SELECT polarity, word, count(*) AS n FROM words WHERE word NOT IN ({sql_list(stopwords.CLOUD)})
  GROUP BY polarity, word
  QUALIFY row_number() OVER (PARTITION BY polarity ORDER BY n DESC, word) <= 200)""", body="""
SELECT polarity, word, n,
       round(n / CAST(max(n) OVER (PARTITION BY polarity) AS DOUBLE), 9) AS weight FROM counts"""))
def cloud_weights(spark, sf_dir):
    return words.cloud_weights(b.reviews(spark, sf_dir))


@query("dictionary", b.with_views(DOC_TERMS, DICTIONARY, body="SELECT * FROM dictionary"))
def dictionary(spark, sf_dir):
    return words.dictionary(words.term_counts(_tokens(spark, sf_dir), "doc_id"), "doc_id")


@query("bag_of_words", b.with_views(DOC_TERMS, DICTIONARY, body="""
SELECT doc_id, term_id, doc_terms.term, n FROM doc_terms JOIN dictionary USING (term)"""))
def bag_of_words(spark, sf_dir):
    return words.bag_of_words(_tokens(spark, sf_dir), "doc_id")[0]


@query("term_document_matrix", b.with_views(DOC_TOKENS, body="SELECT doc_id, " + ", ".join(
    f"CAST(len(list_filter(tokens, lambda t: t = '{w}')) AS BIGINT) AS \"{w}\"" for w in CHOSEN_WORDS)
    + " FROM doc_tokens"))
def term_document_matrix(spark, sf_dir):
    return words.term_document_matrix(_tokens(spark, sf_dir), "doc_id", CHOSEN_WORDS)


TOPIC_SIZES = (b.V_REVIEWS, POLARITY, f"""
words AS (
  SELECT DISTINCT polarity, unnest(regexp_extract_all(lower(review), '[\\p{{L}}\\p{{N}}_]+')) AS term
  FROM polar)""", f"""
vocabulary AS (
  SELECT DISTINCT term FROM words WHERE term NOT IN ({sql_list(stopwords.merged())}))""", STEMS, """
sizes AS (
  SELECT polarity, count(DISTINCT stem) AS n_terms FROM words JOIN stems USING (term)
  GROUP BY polarity)""")


@query("lda_topics", b.with_views(*TOPIC_SIZES, body="""
SELECT polarity, CAST(topic AS INTEGER) AS topic, n_terms, CAST(1 AS DOUBLE) AS total_weight,
       true AS valid
FROM sizes, (SELECT unnest(range(5)) AS topic)"""))
def lda_topics(spark, sf_dir):
    """What holds for every right model: 5 topics per class, each a distribution over all stems."""
    models = topics.lda_topics(materialize(_review_tokens(spark, sf_dir), "review-tokens"))
    return topics.topic_summary(models).select(
        "polarity", "topic", "n_terms", "total_weight",
        ((F.col("min_weight") >= 0) & (F.col("doc_prior") > 0)).alias("valid"))


@query("topic_words", b.with_views(*TOPIC_SIZES, body="""
SELECT polarity, CAST(topic AS INTEGER) AS topic, CAST(place AS INTEGER) AS rank, true AS known,
       true AS falling
FROM sizes, (SELECT unnest(range(5)) AS topic), (SELECT unnest(range(1, 6)) AS place)
WHERE place <= n_terms"""))
def topic_words(spark, sf_dir):
    """What holds for every right model: words of the class's own stems, weights falling from a positive one."""
    tokens = materialize(_review_tokens(spark, sf_dir), "review-tokens")
    before = Window.partitionBy("polarity", "topic").orderBy("rank")
    falling = (F.col("weight") > 0) & (F.col("weight") <= F.coalesce(F.lag("weight").over(before), F.lit(1.0)))
    shown = materialize(topics.topic_words(topics.lda_topics(tokens)).withColumn("falling", falling), "topic-words")
    # All tokens are read, and only those that are shown go on to the distinct.
    asked = F.broadcast(shown.select("polarity", "term").distinct())
    stems = (tokens.select("polarity", F.explode("tokens").alias("term")).join(asked, ["polarity", "term"], "left_semi")
             .distinct().withColumn("found", F.lit(True)))
    return (shown.join(stems, ["polarity", "term"], "left")
            .select("polarity", "topic", "rank", F.coalesce("found", F.lit(False)).alias("known"), "falling"))
