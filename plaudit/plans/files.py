"""Queries over files: each writes a whole table in the format under test and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plaudit import schemas
from plaudit.operators import numbering, search, summary, words
from plaudit.plans import bindings as b
from plaudit.plans.registry import query
from plaudit.scratch import materialize, new_path, release, release_tree, store
from plaudit.sinks import csv as csv_sink, review_files as file_sink, terms as term_sink
from plaudit.sources import csv as csv_source, pages, payloads, review_files, tables

# Results per payload of the fixture.
PAGE = 100

BASE_URL = "https://www.example.com"

NA_FIELDS = """
  'NA' AS userNickname, coalesce(rating, 'NA') AS rating, coalesce(age, 'NA') AS age,
  'NA' AS eyeColor, 'NA' AS hairColor, 'NA' AS skinTone, coalesce(skinType, 'NA') AS skinType,
  review"""


def full_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound reviews with every field of the schema; absent ones are null."""
    rows = b.reviews(spark, sf_dir)
    absent = F.lit(None).cast("string")
    return rows.select("fileIndex", *[
        F.col(c) if c in rows.columns else absent.alias(c) for c in schemas.REVIEW_FIELDS])


def review_payloads(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """Reviews as API pages: at most 100 of one product in a payload, however many it has."""
    result = F.struct(
        F.concat(F.lit("user"), "fileIndex").alias("UserNickname"),
        F.col("rating").alias("Rating"), F.col("review").alias("ReviewText"),
        F.create_map(
            F.lit("age"), F.struct(F.col("age").alias("ValueLabel")),
            F.lit("skinType"), F.struct(F.col("skinType").alias("ValueLabel")),
        ).alias("ContextDataValues"))
    page = F.floor(F.col("fileIndex") / PAGE).alias("page")
    return (b.reviews(spark, sf_dir).groupBy("productID", page)
            .agg(F.to_json(F.struct(F.count("*").alias("TotalResults"),
                                    F.collect_list(result).alias("Results"))).alias("payload"))
            .select("productID", *kept, "payload"))


def product_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listing pages of one brand, at most 100 products each."""
    listed = F.struct(F.col("p_partkey").cast("string").alias("id"),
                      F.col("p_name").alias("display_name"))
    page = F.floor(F.col("p_partkey") / PAGE).alias("page")
    body = F.struct(
        F.lit(PAGE).alias("page_size"), F.count("*").alias("total_products"),
        F.struct(F.first("p_brand").alias("brand_name")).alias("brand"),
        F.collect_list(listed).alias("products"))
    return (b.table(spark, sf_dir, "part")
            .groupBy(F.regexp_extract("p_brand", "[0-9]+", 0).alias("Brand_id"), page)
            .agg(F.to_json(body).alias("payload")))


@query("scan_csv_drop_malformed", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_csv_drop_malformed(spark, sf_dir):
    docs = b.documents(spark, sf_dir)
    path = new_path(spark, "documents-csv")
    csv_sink.write_review_csv(docs, path)
    bad = [(",".join(docs.columns),), ("no number,too short",)]
    spark.createDataFrame(bad, "value STRING").coalesce(1).write.mode("append").text(path)
    return csv_source.read_csv_drop_malformed(spark, path, docs.schema)


@query("scan_csv_infer", """
SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice
FROM part""")
def scan_csv_infer(spark, sf_dir):
    path = new_path(spark, "part-csv")
    csv_sink.write_review_csv(b.table(spark, sf_dir, "part"), path)
    return csv_source.read_csv_infer(spark, path, multi_line=False)


@query("scan_review_text_files", b.with_views(b.V_REVIEWS, body=f"""
SELECT substr(productID, 4) AS dir, CAST(fileIndex AS VARCHAR) AS file, productID, {NA_FIELDS}
FROM v_reviews"""))
def scan_review_text_files(spark, sf_dir):
    path = new_path(spark, "review-files")
    rows = full_reviews(spark, sf_dir).withColumn("folder", F.substring("productID", 4, 9))
    file_sink.write_review_file_tree(rows, path, "folder", "fileIndex")
    return review_files.read_review_text_files(spark, path)[0]


@query("flatten_review_payload", b.with_views(b.V_REVIEWS, body="""
SELECT productID, concat('user', fileIndex) AS userNickname, coalesce(rating, 'NA') AS rating,
  coalesce(age, 'NA') AS age, 'NA' AS eyeColor, 'NA' AS hairColor, 'NA' AS skinTone,
  coalesce(skinType, 'NA') AS skinType, review
FROM v_reviews"""))
def flatten_review_payload(spark, sf_dir):
    return payloads.flatten_review_payload(review_payloads(spark, sf_dir))


@query("review_payload_rejects", b.with_views(b.V_REVIEWS, body=f"""
SELECT productID, page, unnest(['no results', 'no total', 'not a payload']) AS reason
FROM (SELECT DISTINCT productID, CAST(fileIndex // {PAGE} AS BIGINT) AS page FROM v_reviews)"""))
def review_payload_rejects(spark, sf_dir):
    """Each payload as it is, cut off, without its total and without its results: three of four are rejects."""
    whole = review_payloads(spark, sf_dir, "page")
    forms = [F.col("payload"), F.substring("payload", F.lit(1), F.length("payload") - 1),
             F.replace("payload", F.lit('"TotalResults"'), F.lit('"Total"')),
             F.regexp_replace("payload", '(?s),"Results":.*', "}")]
    given = whole.select("productID", "page", F.explode(F.array(*forms)).alias("payload"))
    return payloads.split_review_payload(given)[1].drop("payload")


@query("flatten_product_payload", """
SELECT CAST(p_partkey AS VARCHAR) AS ProductID, p_name AS Product_name,
       regexp_extract(p_brand, '[0-9]+') AS Brand_id, p_brand AS Brand_name
FROM part""")
def flatten_product_payload(spark, sf_dir):
    return payloads.flatten_product_payload(product_payloads(spark, sf_dir))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def entity_sql(value: str) -> str:
    """The SQL of ``pages.decode_entities``."""
    digits = r"regexp_replace(lower(codes[i]), '^(x?)0+(.)', '\1\2')"
    number = f"""CASE WHEN {digits}[1] = 'x' THEN CAST('0x' || {digits}[2:9] AS BIGINT) ELSE CAST({digits}[1:8] AS BIGINT) END"""
    char = f"""CASE WHEN length({digits}) <= 8 AND {number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343
               THEN chr(CAST({number} AS INTEGER)) ELSE '�' END"""
    written = f"""(SELECT array_to_string(list_transform(range(1, len(pieces) + 1), lambda i:
      pieces[i] || CASE WHEN i <= len(codes) THEN {char} ELSE '' END), '') FROM (
        SELECT string_split_regex({value}, {quoted(pages.NUMBERED.replace("(", "(?:", 1))}) AS pieces,
               regexp_extract_all({value}, {quoted(pages.NUMBERED)}, 1) AS codes))"""
    for entity, char in pages.ENTITIES:
        written = f"replace({written}, '{entity}', {quoted(char)})"
    return written


def tags_sql(view: str, name: str, *attributes: str) -> str:
    """Views of the opening tags of ``view(page_id, html)`` with their place and attributes, as in ``pages``."""
    def group(number: int) -> str:
        return f"regexp_extract_all(tag, {quoted(pages.ATTRIBUTE)}, {number})"

    found = ", ".join(f"list_position(list_transform({group(1)}, lambda a: lower(a)), '{a}') AS at_{i}" for i, a in enumerate(attributes))
    raw = ", ".join(f"CASE WHEN at_{i} > 0 THEN concat({group(2)}[at_{i}], {group(3)}[at_{i}], {group(4)}[at_{i}]) END AS raw_{i}"
                    for i in range(len(attributes)))
    values = ", ".join(f'CASE WHEN raw_{i} IS NOT NULL THEN {entity_sql(f"raw_{i}")} END AS "{a}"' for i, a in enumerate(attributes))
    return f"""
listed AS (
  SELECT page_id, regexp_extract_all(regexp_replace(html, {quoted(pages.SKIPPED)}, ' ', 'g'), {quoted(pages.tag_pattern(name))}) AS tags
  FROM {view}),
tags AS (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS place FROM listed),
placed AS (SELECT *, {found} FROM tags),
raws AS (SELECT page_id, place, {raw} FROM placed),
valued AS (SELECT page_id, place, {values} FROM raws)"""


LINK = f"""CASE WHEN regexp_matches(href, '{pages.SCHEME}') THEN href ELSE concat('{BASE_URL}', href) END"""

# What the harvested pages hold, links of a class and marked elements, beside others that only
# look like them: inside values, comments, scripts and headings. The page number goes between.
LISTED, CLASSED = '<li><a href="/', """<li><a title="a > b" CLASS='nav  item' href="&#x2F;&#47;"""
MARKS = (
    '<!-- <a class="nav" href="/comment"> --><script>"<a class=nav href=/script>"</script><a class=navy href=/navy>'
    '<a data-href="/data" title=" href=/title " class=nav href=/last/?a=1&amp;amp;b=&#8364;>'
    '<div certona="BRAND" data-brand_id="0"></div>' "<DIV data-brand_id='",
    "&#x31;' certona=BRAND></DIV>"
    '<div certona="OTHER" data-brand_id="7"></div><title><div certona=BRAND data-brand_id=8></title>')

MARKED = f"""
marked AS (
  SELECT page_id, concat(replace(html, {quoted(LISTED)}, {quoted(CLASSED)}), {quoted(MARKS[0])}, page_id, {quoted(MARKS[1])}) AS html
  FROM pages)"""


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.pages(spark, sf_dir).select("page_id", F.concat(
        F.replace("html", F.lit(LISTED), F.lit(CLASSED)), F.lit(MARKS[0]), F.col("page_id").cast("string"), F.lit(MARKS[1])).alias("html"))


@query("extract_page_links", b.with_views(tags_sql("pages", "a", "href"), body=f"""
SELECT page_id, {LINK} AS link, count(*) AS n FROM valued WHERE href IS NOT NULL GROUP BY ALL"""))
def extract_page_links(spark, sf_dir):
    return pages.extract_page_links(b.pages(spark, sf_dir), BASE_URL)


@query("extract_class_links", b.with_views(MARKED, tags_sql("marked", "a", "href", "class"), body=f"""
SELECT page_id, {LINK} AS link, count(*) AS n FROM valued
WHERE href IS NOT NULL AND list_contains(string_split_regex(class, '[{pages.SPACE}]+'), 'nav') GROUP BY ALL"""))
def extract_class_links(spark, sf_dir):
    return pages.extract_page_links(marked_pages(spark, sf_dir), BASE_URL, css_class="nav")


@query("extract_page_attribute", b.with_views(tags_sql("pages", "div", "class"), body="""
SELECT page_id, arg_max(class, place) FILTER (class IS NOT NULL) AS class
FROM pages LEFT JOIN valued USING (page_id) GROUP BY page_id"""))
def extract_page_attribute(spark, sf_dir):
    return pages.extract_page_attribute(b.pages(spark, sf_dir), "div", "class")


@query("extract_marked_attribute", b.with_views(MARKED, tags_sql("marked", "div", "data-brand_id", "certona"), body="""
SELECT page_id, arg_max("data-brand_id", place) FILTER ("data-brand_id" IS NOT NULL AND certona = 'BRAND') AS data_brand_id
FROM pages LEFT JOIN valued USING (page_id) GROUP BY page_id"""))
def extract_marked_attribute(spark, sf_dir):
    return pages.extract_page_attribute(marked_pages(spark, sf_dir), "div", "data-brand_id", ("certona", "BRAND"))


@query("promote_header_row", b.with_views(b.V_REVIEWS, body="SELECT rating, review FROM v_reviews"))
def promote_header_row(spark, sf_dir):
    path = new_path(spark, "sheet")
    csv_sink.write_review_csv(
        b.reviews(spark, sf_dir).select(F.col("rating").alias("0"), F.col("review").alias("1")), path)
    return csv_source.read_polarity_sheet(spark, path)


@query("register_views", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body="""
SELECT fileIndex, Product_name, rating FROM v_products JOIN v_reviews ON ID = productID
WHERE rating IN ('5', '1')"""))
def register_views(spark, sf_dir):
    tables.register_views(review=b.reviews(spark, sf_dir), product=b.products(spark, sf_dir))
    tables.register_views(alldata=spark.sql(
        "SELECT * FROM product INNER JOIN review ON product.ID = review.productID"))
    return spark.sql(
        "SELECT fileIndex, Product_name, rating FROM alldata WHERE rating = '5' OR rating = '1'")


@query("preview_rows", b.with_views(b.V_REVIEWS, body="""
SELECT * FROM v_reviews ORDER BY fileIndex LIMIT 20"""))
def preview_rows(spark, sf_dir):
    return tables.preview_rows(b.reviews(spark, sf_dir), 20, "fileIndex")


@query("sink_csv_single", b.with_views(b.V_REVIEWS, b.V_PRODUCTS, body="""
SELECT age, count(*) AS n FROM v_products JOIN v_reviews ON ID = productID GROUP BY age"""))
def sink_csv_single(spark, sf_dir):
    path = new_path(spark, "age-csv")
    counts = summary.count_by_age(summary.product_tally(
        b.reviews(spark, sf_dir), b.products(spark, sf_dir), "age"))
    csv_sink.write_result_csv(counts, path, "age")
    return spark.read.schema(counts.schema).options(**csv_source.QUOTING).csv(path)


def rollover(rows: DataFrame, path: str) -> DataFrame:
    """Numbered reviews written in parts of 100 and read back, each with its part."""
    csv_sink.write_csv_rollover(search.null_to_missing(rows, *schemas.REVIEW_FIELDS), path, part_rows=100)
    schema = T.StructType([*schemas.REVIEW, T.StructField("part", T.LongType())])
    return csv_source.read_csv_drop_malformed(rows.sparkSession, path, schema)


@query("sink_csv_rollover", b.with_views(b.V_REVIEWS, body=f"""
SELECT CAST(fileIndex // 100 + 1 AS BIGINT) AS part, fileIndex, productID, {NA_FIELDS}
FROM v_reviews"""))
def sink_csv_rollover(spark, sf_dir):
    return rollover(full_reviews(spark, sf_dir), new_path(spark, "rollover-csv"))


@query("convert_review_files", b.with_views(b.V_REVIEWS, body=f"""
SELECT CAST(new_index // 100 + 1 AS BIGINT) AS part, new_index AS fileIndex, productID, {NA_FIELDS}
FROM (SELECT *, row_number() OVER (ORDER BY CAST(substr(productID, 4) AS BIGINT), fileIndex) - 1
             AS new_index FROM v_reviews)"""))
def convert_review_files(spark, sf_dir):
    """The whole converter: a tree of text files, numbered in file order, written as CSV parts."""
    path = new_path(spark, "convert")
    rows = full_reviews(spark, sf_dir).withColumn("folder", F.substring("productID", 4, 9))
    file_sink.write_review_file_tree(rows, f"{path}/tree", "folder", "fileIndex")
    # The numbering reads the names and the rows: opening a file per review is paid once.
    found = store(review_files.read_review_text_files(spark, f"{path}/tree")[0], f"{path}/found")
    release_tree(spark, f"{path}/tree")
    numbered = numbering.number_reviews(found)[0].select("fileIndex", *schemas.REVIEW_FIELDS)
    numbered = store(numbered, f"{path}/numbered")
    release(spark, f"{path}/found")
    parts = rollover(numbered, f"{path}/parts")
    release(spark, f"{path}/numbered")
    return parts


@query("sink_review_text_dirs", b.with_views(b.V_REVIEWS, body=f"""
SELECT CAST(fileIndex // 100 + 1 AS VARCHAR) AS dir, productID, {NA_FIELDS} FROM v_reviews"""))
def sink_review_text_dirs(spark, sf_dir):
    path = new_path(spark, "review-dirs")
    file_sink.write_review_text_dirs(full_reviews(spark, sf_dir), path, dir_reviews=100)
    return review_files.read_review_text_records(spark, path)[0].drop("file")


@query("sink_review_csv", b.with_views(b.V_REVIEWS, body="""
SELECT fileIndex, productID, rating, age, skinType, review FROM v_reviews"""))
def sink_review_csv(spark, sf_dir):
    path = new_path(spark, "review-csv")
    rows = full_reviews(spark, sf_dir)
    csv_sink.write_review_csv(search.null_to_missing(rows, *schemas.REVIEW_FIELDS), path)
    return csv_source.read_reviews(spark, path).select(
        "fileIndex", "productID", "rating", "age", "skinType", "review")


DOC_TERMS = r"""
doc_terms AS (
  SELECT doc_id, term, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term
    FROM documents) GROUP BY ALL)"""

DICTIONARY = """
dictionary AS (
  SELECT term, row_number() OVER (ORDER BY min(doc_id), term) - 1 AS term_id, count(*) AS doc_freq
  FROM doc_terms GROUP BY term)"""


@query("sink_term_counts", b.with_views(DOC_TERMS, body="SELECT doc_id, term, n FROM doc_terms"))
def sink_term_counts(spark, sf_dir):
    path = new_path(spark, "stored-terms")
    docs = words.tokenize(b.documents(spark, sf_dir), "text")
    term_sink.write_term_counts(words.term_counts(docs, "doc_id"), path)
    return spark.read.parquet(path)


@query("term_count_header", b.with_views(DOC_TERMS, body="""
SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS terms, count(*) AS entries
FROM doc_terms"""))
def term_count_header(spark, sf_dir):
    docs = words.tokenize(b.documents(spark, sf_dir), "text")
    stored = materialize(words.term_counts(docs, "doc_id"), "term-counts")
    return term_sink.term_count_header(stored, "doc_id", "term")


@query("sink_dictionary", b.with_views(DOC_TERMS, DICTIONARY, body="SELECT * FROM dictionary"))
def sink_dictionary(spark, sf_dir):
    path = new_path(spark, "stored-dictionary")
    docs = words.tokenize(b.documents(spark, sf_dir), "text")
    term_sink.write_dictionary(words.dictionary(words.term_counts(docs, "doc_id"), "doc_id"), path)
    return spark.read.parquet(path)


NUMBERED = """
numbered AS (
  SELECT doc_id, substr(source, 4) AS dir,
         row_number() OVER (ORDER BY CAST(substr(source, 4) AS INT), doc_id) - 1 AS fileIndex
  FROM documents)"""


def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = b.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("substr(source, 4)").alias("dir"), F.col("doc_id").cast("string").alias("file"))
    return numbering.number_reviews(named)[0].drop("file")


@query("number_reviews", b.with_views(NUMBERED, body="SELECT doc_id, dir, fileIndex FROM numbered"))
def number_reviews(spark, sf_dir):
    return numbered_documents(spark, sf_dir)


@query("assign_output_part", b.with_views(NUMBERED, body="""
SELECT doc_id, fileIndex, fileIndex // 300 + 1 AS part, fileIndex // 70 + 1 AS dir FROM numbered"""))
def assign_output_part(spark, sf_dir):
    numbered = numbered_documents(spark, sf_dir).drop("dir")
    return numbering.assign_output_part(numbered, "fileIndex", 300, 70)


@query("sort_numeric_names", """
SELECT name, CAST(name AS BIGINT) AS number,
       row_number() OVER (ORDER BY CAST(name AS BIGINT), name) - 1 AS position
FROM (SELECT DISTINCT substr(source, 4) AS name FROM documents)""")
def sort_numeric_names(spark, sf_dir):
    names = b.table(spark, sf_dir, "documents").select(F.expr("substr(source, 4)").alias("name"))
    return numbering.sort_numeric_names(names.distinct(), "name")


@query("top_k", """
SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey
ORDER BY n DESC, l_partkey LIMIT 20""")
def top_k(spark, sf_dir):
    counts = b.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return numbering.top_k(counts, "n", 20, "l_partkey")
