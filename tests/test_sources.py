import csv
import json
import random
from contextlib import contextmanager

import pytest
from pyarrow import fs
from pyspark.sql import functions as F, types as T

from plaudit import schemas
from plaudit.sinks import csv as csv_sink, review_files as file_sink
from plaudit.sources import csv as csv_source, pages, payloads, records, review_files, tables


def test_csv_keeps_newlines_quotes_and_letters(spark, reviews, tmp_path):
    path = str(tmp_path / "r")
    csv_sink.write_review_csv(reviews, path)
    back = csv_source.read_reviews(spark, path)
    expected = {tuple(None if v == "NA" else v for v in r) for r in reviews.collect()}
    assert {tuple(r) for r in back.collect()} == expected


def test_csv_from_another_writer(spark, tmp_path):
    path = tmp_path / "r.csv"
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(["fileIndex", *schemas.REVIEW_FIELDS])
        writer.writerow([7, "P1", "NA", "5", "NA", "NA", "NA", "NA", "NA", 'She said "x",\nthen ü'])
    row = csv_source.read_reviews(spark, str(path)).collect()[0]
    assert row.review == 'She said "x",\nthen ü' and row.age is None and row.fileIndex == 7


def test_csv_with_row_labels_in_front(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(",fileIndex," + ",".join(schemas.REVIEW_FIELDS) + "\n"
                    "0,3,P1,ann,5,NA,,NA,NA,Dry,fine\n2,4,P1,too,few\n")
    rows = csv_source.read_reviews(spark, str(path), "_c0").collect()
    assert [(r["_c0"], r.fileIndex, r.age, r.eyeColor, r.review) for r in rows] == [
        (0, 3, None, None, "fine")]


def test_malformed_rows_do_not_depend_on_the_columns_read(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("ID,Product_name,Brand_id,Brand_name\nP1,Glow,1,Alpha\nP2,short\n"
                    "P3,Too,2,many,columns\nP4,Tint,2,NA\n")
    read = csv_source.read_products(spark, str(path))
    assert sorted(r.ID for r in read.collect()) == ["P1", "P4"]
    assert read.select("ID").count() == 2 and read.count() == 2
    assert read.where("ID = 'P4'").collect()[0].Brand_name is None


def test_csv_type_inference(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c\n1,x,1.5\n2,y,2.5\n")
    assert csv_source.read_csv_infer(spark, str(path)).dtypes == [
        ("a", "int"), ("b", "string"), ("c", "double")]


@contextmanager
def splits(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_one_large_file_without_newlines_is_read_in_splits(spark, tmp_path):
    path = tmp_path / "p.csv"
    lines = [f'P{i},"Glow, ""new"" {i}",1,Alpha' for i in range(3000)]
    path.write_text("\n".join(["ID,Product_name,Brand_id,Brand_name", *lines]) + "\n")
    with splits(spark, 20_000):
        split, whole = (csv_source.read_products(spark, str(path), multi_line=m) for m in (False, True))
        assert split.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
        assert split.count() == 3000


# How one file with newlines in its texts is read: as one task, and as many.
SHEET = "id LONG, text STRING, more STRING"


def write_sheet(path, rng, end, rows=150):
    pieces = ['"', '""', ",", "\n", "\n\n", "\t", "'", "\\", " ", "é", "漢", "a", "NA", "word"]
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        # Spark takes the first line end it meets for that of the whole file.
        writer.writerow(["id", "te\nxt" if end == "\n" else "text", "more"])
        for i in range(rows):
            writer.writerow([i, "".join(rng.choice(pieces) for _ in range(rng.randrange(14))), rng.choice(["x", "", "a\nb"])])
            out.write(rng.choice([""] * 20 + ["bad line" + end, '7,in " middle,ok' + end, end, '8,"' + "long\n" * 300 + '",ok' + end]))
        out.write('9,"open at the end\nof the file')


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_newlines_in_texts_are_read_in_splits(spark, tmp_path, end):
    rng = random.Random(len(end))
    for name in "ab":
        write_sheet(tmp_path / f"{name}.csv", rng, end)
    schema = T.StructType.fromDDL(SHEET)
    reader = spark.read.schema(schema).options(**csv_source.READING, multiLine=True).option("columnPruning", False)
    expected = sorted(map(str, reader.option("mode", "DROPMALFORMED").csv(str(tmp_path)).collect()))
    assert len(expected) > 300
    for size in (1 << 27, 5000, 400):
        with splits(spark, size):
            found = csv_source.read_csv_drop_malformed(spark, str(tmp_path), schema)
            assert sorted(map(str, found.collect())) == expected, size
            lines, _ = records._lines(spark, str(tmp_path))
            assert size > 5000 or lines.rdd.getNumPartitions() > 4


def test_states_of_splits_do_not_depend_on_the_size_of_splits(spark, tmp_path):
    write_sheet(tmp_path / "a.csv", random.Random(3), "\n")
    data = (tmp_path / "a.csv").read_bytes()
    with splits(spark, 300):
        found = {r.start: r for r in records.split_states(records._lines(spark, str(tmp_path))[0].drop("folder")).collect()}
    assert len(found) > 20 and any(r.inside for r in found.values())
    inside, place, state = False, 0, {}
    for line in data.split(b"\n"):
        state[place] = inside
        inside = records.ends_inside(line, inside)
        place += len(line) + 1
    for start, row in found.items():
        # A split owns the lines that start behind its first byte; the first split owns the first line too.
        first = min(p for p in state if p > start or p == start == 0)
        assert row.inside == state[first], start
        if row.inside:
            assert row.opener < start


def test_partition_folders_of_records_are_columns(spark, tmp_path):
    for part in (1, 2):
        (tmp_path / f"part={part}").mkdir()
        (tmp_path / f"part={part}" / "x.csv").write_text(f'a,b\n{part},"one\ntwo"\n')
    found = csv_source.read_csv_drop_malformed(spark, str(tmp_path), T.StructType.fromDDL("a INT, b STRING, part LONG"))
    assert sorted(map(tuple, found.collect())) == [(1, "one\ntwo", 1), (2, "one\ntwo", 2)]


def test_sheet_header_is_replaced(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("whatever,header\n5,good\n1,bad\n")
    rows = csv_source.read_polarity_sheet(spark, str(path)).collect()
    assert [(r.rating, r.review) for r in rows] == [("5", "good"), ("1", "bad")]


def test_sheets_with_long_headers_and_newlines_are_read_in_splits(spark, tmp_path):
    for name in "ab":
        rows = "".join(f'{i % 5 + 1},"{name}{i}\nsecond ""line"""\n' for i in range(300))
        (tmp_path / f"{name}.csv").write_text('"head\n' + "er " * 200 + '",header\n' + rows + "3\n")
    with splits(spark, 500):
        found = csv_source.read_polarity_sheet(spark, str(tmp_path)).collect()
    expected = [(str(i % 5 + 1), f'{name}{i}\nsecond "line"') for name in "ab" for i in range(300)] + [("3", None)] * 2
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def _review_text(*fields):
    return "\t".join(fields)


def test_review_text_files(spark, tmp_path):
    nine = ["P1", "ann", "5", "NA", "NA", "NA", "NA", "Dry", "line one\nline two"]
    for folder, name, text in [
        ("2", "10.txt", _review_text(*nine)), ("10", "2.txt", _review_text(*nine, "cut")),
        ("10", "3.txt", _review_text(*nine[:8])), ("10", ".DS_Store", "x"), ("10", "notes.md", "x"),
    ]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    reviews, rejects = review_files.read_review_text_files(spark, str(tmp_path))
    rows = {(r.dir, r.file): r.review for r in reviews.collect()}
    assert rows == {("2", "10"): "line one\nline two", ("10", "2"): "line one\nline two"}
    assert [(r.n_fields, r.path.endswith("/10/3.txt")) for r in rejects.collect()] == [(8, True)]


def test_review_file_tree_round_trip(spark, reviews, tmp_path):
    rows = reviews.withColumn("dir", F.col("fileIndex") % 2)
    file_sink.write_review_file_tree(rows, f"file://{tmp_path}/tree", "dir", "fileIndex")
    assert sorted(str(p.relative_to(tmp_path / "tree")) for p in (tmp_path / "tree").rglob("*.txt")) == sorted(
        f"{i % 2}/{i}.txt" for i in range(7))
    back, rejects = review_files.read_review_text_files(spark, str(tmp_path / "tree"))
    # A tab inside a review cuts it, as in the harvest.
    expected = {(str(r.fileIndex % 2), str(r.fileIndex), *[(r[c] if r[c] is not None else "NA").split("\t")[0] for c in schemas.REVIEW_FIELDS])
                for r in rows.collect()}
    assert {tuple(r) for r in back.collect()} == expected and rejects.count() == 0


def _payload(total, *results):
    return json.dumps({"TotalResults": total, "Results": list(results)})


def _result(name, context=None, **fields):
    return {"UserNickname": name, "Rating": 5, "ReviewText": "fine",
            "ContextDataValues": context, **fields}


def test_review_payload_edges(spark):
    full = {"age": {"ValueLabel": "18-24"}, "skinType": {"ValueLabel": None}}
    rows = [
        ("P1", _payload(2, _result("ann", full), _result(None, {}, Rating=None, ReviewText=None))),
        ("P2", _payload(0)), ("P3", _payload(None, _result("x"))), ("P4", "<html>not json"),
        ("P5", json.dumps({"TotalResults": 3, "Results": []})),
        ("P6", _payload(1, _result("kept"), _result("beyond the total"))),
    ]
    flat = payloads.flatten_review_payload(
        spark.createDataFrame(rows, "productID STRING, payload STRING"))
    got = {(r.productID, r.userNickname): r for r in flat.collect()}
    assert set(got) == {("P1", "ann"), ("P1", "NA"), ("P6", "kept")}
    ann, none = got["P1", "ann"], got["P1", "NA"]
    assert (ann.rating, ann.age, ann.skinType, ann.eyeColor) == ("5", "18-24", "NA", "NA")
    assert (none.rating, none.review, none.age) == ("NA", "NA", "NA")
    assert got["P6", "kept"].age == "NA"


def test_review_payload_pages(spark):
    page = [_result(f"u{i}") for i in range(100)]
    rows = [("P", offset, _payload(150, *page)) for offset in (0, 100, 200)]
    df = spark.createDataFrame(rows, "productID STRING, offset INT, payload STRING")
    assert payloads.flatten_review_payload(df, offset="offset").count() == 150


def test_payloads_that_cannot_be_read_are_rejects(spark):
    rows = [("ok", _payload(1, _result("ann"))), ("none", _payload(0)), ("cut", _payload(1, _result("ann"))[:-3]), ("null", None),
            ("text", "<html>not json"), ("list", "[1]"), ("total", _payload(None, _result("x"))), ("bare", json.dumps({"TotalResults": 3})),
            ("word", json.dumps({"TotalResults": "many", "Results": []})), ("short", json.dumps({"TotalResults": 3, "Results": []}))]
    rows, rejects = payloads.split_review_payload(spark.createDataFrame(rows, "productID STRING, payload STRING"))
    assert [r.productID for r in rows.collect()] == ["ok"]
    assert {r.productID: r.reason for r in rejects.collect()} == {
        "cut": "not a payload", "null": "not a payload", "text": "not a payload", "list": "not a payload", "word": "not a payload",
        "total": "no total", "bare": "no results"}
    assert rejects.columns == ["productID", "payload", "reason"]


def test_listings_that_disagree_with_their_total_are_rejects(spark):
    def body(total, *names):
        return json.dumps({"page_size": 2, "total_products": total, "brand": {"brand_name": "B"},
                           "products": [{"id": n, "display_name": n} for n in names]})
    rows = [("1", body(2, "a", "b")), ("2", body(1, "c", "d")), ("3", body(3, "e", "f")), ("4", "{"), ("5", body(None, "g")), ("6", body(0))]
    found, rejects = payloads.split_product_payload(spark.createDataFrame(rows, "Brand_id STRING, payload STRING"))
    assert sorted(r.ProductID for r in found.collect()) == ["a", "b", "c", "e", "f"]
    assert {r.Brand_id: r.reason for r in rejects.collect()} == {
        "2": "total 1, given 2", "3": "total 3, given 2", "4": "not a payload", "5": "no total"}
    paged = [("1", body(3, "a", "b")), ("1", body(3, "c")), ("2", body(3, "d", "e")), ("2", body(3)), (None, body(1, "f"))]
    found, rejects = payloads.split_product_payload(spark.createDataFrame(paged, "Brand_id STRING, payload STRING"), pages=True)
    assert found.count() == 6 and [(r.Brand_id, r.reason) for r in rejects.collect()] == [("2", "total 3, given 2")] * 2


def test_product_payload_edges(spark):
    def body(total, brand, *products):
        return json.dumps({"page_size": 60, "total_products": total,
                           "brand": {"brand_name": brand}, "products": list(products)})
    rows = [("7", body(2, None, {"id": "P1", "display_name": "Glow"}, {"id": "P2"})),
            ("8", body(0, "Empty"))]
    flat = payloads.flatten_product_payload(
        spark.createDataFrame(rows, "Brand_id STRING, payload STRING"))
    assert flat.columns == ["ProductID", "Product_name", "Brand_id", "Brand_name"]
    assert sorted(tuple(r) for r in flat.collect()) == [
        ("P1", "Glow", "7", "NA"), ("P2", "NA", "7", "NA")]


def test_page_links_and_attributes(spark):
    html = ('<a class="x y" href="/one">1</a><A href="/upper">u</A><a href="https://h.org/t">t</a>'
            '<a class="x y" href="/one">1</a><a name="none">n</a>'
            '<div data-brand_id="1" certona="OTHER"></div><div certona="BRAND" data-brand_id="2">'
            '</div><div certona="BRAND" data-brand_id="3"></div><div class="z"></div>')
    df = spark.createDataFrame([(1, html), (2, "plain"), (3, None)], "page_id LONG, html STRING")
    links = {(r.page_id, r.link): r.n for r in pages.extract_page_links(df, "http://b").collect()}
    assert links == {(1, "http://b/one"): 2, (1, "http://b/upper"): 1, (1, "https://h.org/t"): 1}
    marked = pages.extract_page_links(df, "http://b", css_class="x y").collect()
    assert [(r.link, r.n) for r in marked] == [("http://b/one", 2)]
    brand = pages.extract_page_attribute(df, "div", "data-brand_id", ("certona", "BRAND"))
    assert {r.page_id: r.data_brand_id for r in brand.collect()} == {1: "3", 2: None, 3: None}


def test_payloads_of_any_length_are_whole_and_parsed_once(spark):
    results = ",".join('{"UserNickname":"u%d","Rating":5,"ReviewText":"t"}' % i for i in range(150))
    df = spark.createDataFrame([('{"TotalResults":150,"Results":[%s]}' % results,), ("no json",), (None,)], "payload STRING")
    rows = payloads.flatten_review_payload(df)
    assert rows.count() == 150 and payloads.flatten_review_payload(df, page=100).count() == 100
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json") <= 1


def test_attributes_of_any_case_and_quoting(spark):
    html = """<a class='k other' href='/x'>1</a><A HREF="/z?a=1&amp;b=2">2</A><a href=/plain>3</a><DIV class=one></DIV>"""
    df = spark.createDataFrame([(1, html)], "page_id LONG, html STRING")
    links = {r.link for r in pages.extract_page_links(df, "http://h").collect()}
    assert links == {"http://h/x", "http://h/z?a=1&b=2", "http://h/plain"}
    assert {r.link for r in pages.extract_page_links(df, "http://h", css_class="k").collect()} == {"http://h/x"}
    assert pages.extract_page_attribute(df, "div", "class").first()["class"] == "one"


SPACE = " \t\n\f\r"


def scan_tags(html, name):
    """Opening tags by reading character by character: (first value of each attribute), in order."""
    low, out, i = html.lower(), "", 0
    while i < len(html):
        end = None
        if low.startswith("<!--", i):
            close = low.find("-->", i + 4)
            end = len(html) if close < 0 else close + 3
        for element in pages.TEXT_ELEMENTS:
            after = i + 1 + len(element)
            if low.startswith("<" + element, i) and low[after:after + 1] and low[after] in SPACE + "/>" and ">" in low[after:]:
                at = low.index(">", after) + 1
                while end is None:
                    close = low.find("</" + element, at)
                    if close < 0:
                        end = len(html)
                    elif low[close + 2 + len(element):][:1] and low[close + 2 + len(element)] in SPACE + "/>":
                        end = close + 3 + len(element)
                    at = close + 1
        out, i = (out + " ", end) if end else (out + html[i], i + 1)
    tags, i, html = [], 0, out
    while i < len(html):
        found = scan_tag(html, i, name)
        if found:
            tags.append(found[0])
        i = found[1] if found else i + 1
    return tags


def scan_tag(html, i, name):
    if html[i] != "<" or html[i + 1:i + 1 + len(name)].lower() != name:
        return None
    i, values, word, last = i + 1 + len(name), {}, "", None
    if i >= len(html) or html[i] not in SPACE + "/>":
        return None
    while i < len(html):
        char = html[i]
        if char == "=":
            word, last = "", word or last
            i += 1
            while i < len(html) and html[i] in SPACE:
                i += 1
            if i == len(html):
                return None
            if html[i] == ">":
                continue
            if html[i] in "'\"":
                close = html.find(html[i], i + 1)
                if close < 0:
                    return None
                value, i = html[i + 1:close], close + 1
            else:
                start = i
                while i < len(html) and html[i] not in SPACE + ">":
                    i += 1
                value = html[start:i]
            if last:
                values.setdefault(last.lower(), value)
            last = None
        elif char in SPACE + "/>":
            last, word = (word or last) if char in SPACE else None, ""
            if char == ">":
                return values, i + 1
            i += 1
        elif char in "'\"":
            return None
        else:
            word, last = word + char, None
            i += 1
    return None


def test_tags_agree_with_a_scanner(spark):
    rng = random.Random(21)
    pieces = ["<a ", "<a\t", "<A/", "<a>", "<ab ", "href=", "HREF = ", "data-href=", "title=", '"', '"', "'", "'", ">", "> ", "/", " ", "\n", "x", "y=z",
              "/p", "=", "<!--", "-->", "<script>", "</script>", "<style x=y>", "</style >", "<title>", "</title>", "&amp;", "a>b", '"x>y"', "'u v'", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(3, 40))) for _ in range(3000)]
    texts += ['<a title="a>b" href=x>', "<!-- <a href=no> --><a href=yes>", '<a href="1" href="2">', "<a\nhref\n=\n'3'>", "<a href=a\"b'c>",
              '<a title=" href=no " data-href=no href=yes/>', "<script><a href=no></script ><a href=yes>", '<a b="1"href="2">', "<a href=>", "<a href>"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id LONG, html STRING").repartition(4)
    tags = F.transform(pages.opening_tags("html", "a"), lambda t: pages.attribute_value(t, "href"))
    plain = {"&amp;": "&"}
    for row in df.select("page_id", tags.alias("hrefs")).collect():
        expected = [tag.get("href") for tag in scan_tags(texts[row.page_id], "a")]
        expected = [v if v is None else v.replace("&amp;", plain["&amp;"]) for v in expected]
        # A name with nothing behind it has an empty value for the reader and none for the scanner.
        assert [v or None for v in row.hrefs] == [v or None for v in expected], texts[row.page_id]


def test_character_references(spark):
    texts = {"&#x2F;": "/", "&#47": "/", "&#X00041;b": "Ab", "&#8364;": "€", "&#x1F600;": "\U0001f600", "&#0;": "\ufffd", "&#xD800;": "\ufffd",
             "&#99999999999999999999;": "\ufffd", "&#x110000;": "\ufffd", "&amp;#47;": "&#47;", "&amp;lt;": "&lt;", "&apos;&quot;&lt;&gt;": "'\"<>",
             "": "", "&#;": "&#;", "a&#98;c&#x64;e&#": "abcde&#"}
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").repartition(2)
    assert {r.t: r.v for r in df.select("t", pages.decode_entities(F.col("t")).alias("v")).collect()} == texts


def test_csv_round_trip_of_random_texts(spark, tmp_path):
    rng = random.Random(2)
    pieces = ['"', '""', ",", "\n", "\r\n", "\t", "'", "\\", " ", "é", "漢", "a", "NA", "#", ";", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(2000)]
    rows = list(enumerate(texts)) + [(9999, None)]
    df = spark.createDataFrame(rows, "id LONG, text STRING").repartition(3)
    csv_sink.write_review_csv(df, str(tmp_path / "x"))
    back = csv_source.read_csv_drop_malformed(spark, str(tmp_path / "x"), df.schema)
    got = {r.id: r.text for r in back.collect()}
    assert [(i, t, got.get(i)) for i, t in rows if got.get(i, "gone") != t] == []
    assert len(got) == len(rows)


def test_many_small_review_files_are_read_in_few_tasks(spark, tmp_path):
    """The reader alone makes a task of each 32 files; every file is read once, and the session is left as it was."""
    fields = "\t".join(["p", "u", "5", "a", "e", "h", "s", "t", "text"])
    for i in range(6):
        (tmp_path / "tree" / str(i)).mkdir(parents=True)
        for j in range(400):
            (tmp_path / "tree" / str(i) / f"{j}.txt").write_text(f"{fields} {i} {j}")
    name = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before = spark.conf.get(name)
    rows, rejects = review_files.read_review_text_files(spark, str(tmp_path / "tree"))
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {(r.dir, r.file, r.review) for r in rows.collect()} == {(str(i), str(j), f"text {i} {j}") for i in range(6) for j in range(400)}
    assert rejects.count() == 0 and spark.conf.get(name) == before


def test_review_file_names_stay_in_tasks(spark, tmp_path, monkeypatch):
    """Spark's reader would hold every name on the driver. Names that it leaves out are left out, at any depth and batch size."""
    monkeypatch.setattr(review_files, "BATCH_ROWS", 2, raising=False)
    monkeypatch.setattr(review_files, "BATCH_BYTES", 40, raising=False)
    fields = "\t".join("puraehst")
    names = ["1/1", "1/2", "1/3", "1/_a=4", "d.txt/5", "deep/er/6 é%", "7", "_k=1/8"]
    for name in [*names, "1/.9", "1/_10", "_h/11", ".h/12"]:
        place = tmp_path / "a tree" / f"{name}.txt"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(f"{fields}\tof {name}")
    for name, text in (("1/13.TXT", "x"), ("1/14.txt.md", "x"), ("1/15.txt", ""), ("1/16.txt", "short")):
        (tmp_path / "a tree" / name).write_text(text)
    (tmp_path / "a tree" / "empty").mkdir()
    (tmp_path / "a tree" / "1" / "gone.txt").symlink_to(tmp_path / "nowhere")
    rows, rejects = review_files.read_review_text_files(spark, str(tmp_path / "a tree"))
    assert not [name for df in (rows, rejects) for name in df.inputFiles() if name.endswith(".txt")]
    expected = {(f"a%20tree/{name}".split("/")[-2], name.split("/")[-1].replace("%", "%25").replace(" ", "%20"), f"of {name}") for name in names}
    assert {(r.dir, r.file, r.review) for r in rows.collect()} == expected and rows.count() == len(names)
    assert [tuple(r) for r in rejects.collect()] == [(f"file:{tmp_path}/a%20tree/1/16.txt", "short", 1)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        review_files.read_review_text_files(spark, str(tmp_path / "no tree"))
    assert review_files.read_review_text_files(spark, str(tmp_path / "a tree" / "empty"))[0].count() == 0


def test_folders_of_other_stores_are_listed(tmp_path):
    (tmp_path / "x" / "sub").mkdir(parents=True)
    (tmp_path / "x" / "1.txt").write_text("a")
    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    assert sorted(review_files._children(store, "x")) == [("x/1.txt", False), ("x/sub", True)]


def test_a_store_without_arrow_is_read_by_spark(spark, tmp_path, monkeypatch):
    def closed(path):
        raise OSError("no such library")

    (tmp_path / "1").mkdir()
    (tmp_path / "1" / "2.txt").write_text("\t".join("puraehst") + "\ttext")
    monkeypatch.setattr(review_files, "file_place", closed)
    rows, rejects = review_files.read_review_text_files(spark, str(tmp_path))
    assert [(r.dir, r.file, r.review) for r in rows.collect()] == [("1", "2", "text")] and rejects.count() == 0
