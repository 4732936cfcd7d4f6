"""WARC archives: written as whole-file gzip streams, normalised to one gzip member a record, read by index."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaudit.scratch import file_place, new_path, release, store

# Payloads of at least this many bytes are kept once; later copies revisit it.
MIN_BYTES = 1000

# Fixed values of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Endings of an archive whose records are members of their own, and of its offset index.
ARCHIVE, INDEX = ".warc.gz", ".cdx"

# Bytes that are inflated or read at a time, and stored bytes that one reading task should get.
CHUNK, TASK_BYTES = 1 << 18, 64 << 20

INDEX_FIELDS = ("offset", "length", "type", "record_id", "target_uri")


def find_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` as (page, key, digest, size, newest): ``newest`` is the key that a revisit refers to, else null.

    Among payloads that are equal and have ``min_bytes`` bytes or more, the largest key is the
    response and the others refer to it; rows that repeat the largest key are responses too, and a
    null key is smaller than all. The largest keys are a stored table, so the join has two plain
    sides and a payload that most pages share can be split.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    marked = pages.select(F.struct("*").alias("page"), F.col(key).alias("key"), F.sha1(body).alias("digest"),
                          F.octet_length(body).cast("long").alias("size"))
    groups = marked.where(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.max("key").alias("newest"), F.count("*").alias("n")).where("n > 1 AND newest IS NOT NULL").drop("n")
    newest = store(groups, new_path(pages.sparkSession, "newest"))
    older = F.col("key").isNull() | (F.col("key") < F.col("newest"))
    return marked.join(newest, "digest", "left").withColumn("newest", F.when(older, F.col("newest")))


def _name(key: Column, digest: Column) -> Column:
    """Record id of a page: its key, unless it is null, and the digest of its payload."""
    page = F.coalesce(F.concat(F.lit("page:"), F.url_encode(key.cast("string")), F.lit(":")), F.lit("nopage:"))
    return F.concat(F.lit("<urn:"), page, digest, F.lit(">"))


def _header_value(value: Column) -> Column:
    """A URL that cannot end a header line: blanks and line ends are encoded, other control characters go."""
    for char in " \t\n\r":
        value = F.replace(value, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]", "")


def page_records(revisits: DataFrame, url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(value): one WARC record for each row of ``find_revisits``, without the blank lines behind it.

    A record is named by key and payload digest. A revisit holds the HTTP header alone, with the
    length of the payload that it does not repeat.
    """
    body = F.coalesce(F.col(f"page.{payload}").cast("string"), F.lit(""))
    http = F.concat(F.lit(HTTP), F.col("size"), F.lit(CRLF * 2))
    block = F.when(F.col("newest").isNull(), F.concat(http, body)).otherwise(http)
    refers = F.when(F.col("newest").isNotNull(), F.concat(
        F.lit("WARC-Refers-To: "), _name(F.col("newest"), F.col("digest")), F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}")))
    target = F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col(f"page.{url}").cast("string")), F.lit(CRLF))
    return revisits.select(F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: "), F.when(F.col("newest").isNull(), "response").otherwise("revisit"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _name(F.col("key"), F.col("digest")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}"),
        F.coalesce(target, F.lit("")), F.coalesce(refers, F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block), F.lit(CRLF * 2), block).alias("value"))


def write_archives(records: DataFrame, folder: str) -> None:
    """Records as WARC files, each file one gzip stream from its first record to its last.

    The two line ends behind a record are the writer's line separator, so files are committed by
    Spark and a lost executor leaves none behind.
    """
    records.write.option("compression", "gzip").option("lineSep", CRLF * 2).text(folder)


class Inflated:
    """A gzip file, of one member or several, inflated once from start to end in bounded pieces."""

    def __init__(self, source) -> None:
        self.source, self.held, self.read = source, bytearray(), 0
        self.stream = zlib.decompressobj(31)

    def fill(self) -> bool:
        """Inflate one more piece; False at the end of the file."""
        rest = self.stream.unconsumed_tail or self.stream.unused_data
        if not rest:
            rest = self.source.read(CHUNK)
            self.read += len(rest)
        if not rest:
            return False
        if self.stream.eof:
            self.stream = zlib.decompressobj(31)
        self.held += self.stream.decompress(rest, CHUNK)
        return True

    def header(self) -> bytes | None:
        """The header of the next record with its blank line; None at the end of the file."""
        start = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, start - 3))) < 0:
            start = len(self.held)
            if not self.fill():
                if self.held.strip():
                    raise ValueError("the file ends inside a header")
                if self.read and not self.stream.eof:
                    raise ValueError("the stream is cut off")
                return None
        return self.take(end + 4)

    def take(self, size: int) -> bytes:
        found = bytes(self.held[:size])
        del self.held[:size]
        return found

    def body(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in pieces."""
        while size:
            if not self.held and not self.fill():
                raise ValueError("the file ends inside a record")
            piece = self.take(min(size, len(self.held)))
            size -= len(piece)
            if piece:
                yield piece


def header_fields(header: bytes) -> dict[str, str]:
    """Fields of a WARC or HTTP header by lower-case name; the first line has none."""
    fields = {}
    for line in header.decode("utf-8", "replace").split(CRLF)[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def content_length(fields: dict[str, str]) -> int:
    if not re.fullmatch("[0-9]+", fields.get("content-length", "")):
        raise ValueError("a record has no content length")
    return int(fields["content-length"])


def normalise(source, archive, sidecar) -> tuple[int, str | None]:
    """Rewrite every record of an inflated file as a gzip member, and list the members.

    Returns the number of records and, if the file is cut off or broken, what is wrong with it:
    the whole records before the fault are written.
    """
    reader, records, offset = Inflated(source), 0, 0
    try:
        while (header := reader.header()) is not None:
            header = header.lstrip(b"\r\n")
            if not header:
                continue
            fields = header_fields(header)
            member = zlib.compressobj(6, zlib.DEFLATED, 31)
            parts = [member.compress(header)]
            for piece in reader.body(content_length(fields)):
                parts.append(member.compress(piece))
            parts += [member.compress(b"\r\n\r\n"), member.flush()]
            held = sum(map(len, parts))
            for part in parts:
                archive.write(part)
            listed = (offset, held, fields.get("warc-type", ""), fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""))
            sidecar.write(("\t".join(re.sub(r"[\t\r\n]", " ", str(x)) for x in listed) + "\n").encode())
            records, offset = records + 1, offset + held
    except (ValueError, zlib.error) as error:
        return records, str(error)
    return records, None


def normalise_archives(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(path, records, bytes, error) of every gzip file under ``source``, rewritten under ``target``.

    Each file is inflated once, as a stream; every record becomes a gzip member of its own in an
    archive of the same name, and a sidecar index holds offset, length, type, id and URL of each.
    Files are packed into tasks by size from their names alone. A task writes under a name of its
    own and renames when it is done, so a repeated task writes the same files again. A file that
    is cut off gives its whole records and says so in ``error``.
    """
    spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(path) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "records", "bytes", "error"])

    def one(path: str) -> tuple[str, int, int, str | None]:
        system, at = file_place(path)
        stem = re.sub(r"(\.warc|\.txt)?\.gz$", "", at.rsplit("/", 1)[-1])
        there, folder = file_place(target)
        names = [f"{folder}/{stem}{end}" for end in (ARCHIVE, INDEX)]
        own = [f"{folder}/.{uuid.uuid4().hex}{end}" for end in (ARCHIVE, INDEX)]
        with (system.open_input_stream(at, compression=None) as stream,
              there.open_output_stream(own[0], compression=None) as archive,
              there.open_output_stream(own[1], compression=None) as sidecar):
            records, error = normalise(stream, archive, sidecar)
            size = archive.tell()
        for mine, name in zip(own, names):
            there.move(mine, name)
        return path, records, size, error

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(source)
    report = files.select("path").mapInArrow(run, "path string, records long, bytes long, error string")
    return store(report, new_path(spark, "normalised"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, offset, length, type, record_id, target_uri): the sidecar indexes of a folder."""
    lines = spark.read.schema("value string").option("pathGlobFilter", f"*{INDEX}").option("lineSep", "\n").text(folder)
    fields = F.split("value", "\t", len(INDEX_FIELDS))
    return lines.select(
        F.regexp_replace(F.col("_metadata.file_path"), re.escape(INDEX) + "$", ARCHIVE).alias("archive"),
        *[fields[i].cast("long" if i < 2 else "string").alias(name) for i, name in enumerate(INDEX_FIELDS)])


def read_records(index: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(record_id, type, target_uri, refers_to, digest, http_length, payload) of the records that an index lists.

    Each task opens few archives and reads neighbouring members; there is one task for about
    ``task_bytes`` of them. The payload is what follows the HTTP header.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    kinds = (*[pa.string()] * 5, pa.int64(), pa.binary())
    names = ["record_id", "type", "target_uri", "refers_to", "digest", "http_length", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, rows, held = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != path:
                    system, at = file_place(archive)
                    path, file = archive, system.open_input_file(at)
                file.seek(offset)
                rows.append(parse(zlib.decompress(file.read(length), 31)))
                held += len(rows[-1][-1])
                if held > 16 << 20 or len(rows) >= 1000:
                    yield packed(rows)
                    rows, held = [], 0
        yield packed(rows)

    def parse(record: bytes) -> tuple:
        head = record.index(b"\r\n\r\n") + 4
        fields = header_fields(record[:head])
        block = record[head:head + content_length(fields)]
        start = block.find(b"\r\n\r\n") + 4 if "application/http" in fields.get("content-type", "") else 0
        length = header_fields(block[:start]).get("content-length")
        return (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(length) if length else None, block[start:])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    dealt = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "record_id string, type string, target_uri string, refers_to string, digest string, "
                                 "http_length long, payload binary")


def archive_pages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                  min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write one WARC record for each row of ``pages`` and normalise the archives into ``folder``.

    Returns the report of the normaliser. A null payload is empty, a null URL has no header; an
    empty table gives no record. Repeated rows are records each; other columns are not kept.
    """
    spark = pages.sparkSession
    whole = new_path(spark, "monolithic")
    chosen = pages.select(key, url, payload)
    write_archives(page_records(find_revisits(chosen, key, payload, min_bytes), url, payload), whole)
    report = normalise_archives(spark, whole, folder)
    faulty = report.where("error IS NOT NULL").first()
    if faulty:
        raise OSError(f"{faulty['path']}: {faulty['error']}")
    release(spark, whole)
    return report


def page_digests(records: DataFrame, key: str = "page_id", kind: str = "long") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of records that pages were written to.

    Of a response both come from the payload that was read; of a revisit, which has none, from
    the HTTP length and the payload digest that it carries.
    """
    def page(name: str) -> Column:
        found = F.regexp_extract(name, "^<urn:page:(.*):[0-9a-f]*>$", 1)
        return F.when(F.startswith(F.col(name), F.lit("<urn:page:")), F.url_decode(found)).cast(kind)

    response = F.col("type") == "response"
    return records.select(
        page("record_id").alias(key),
        F.when(response, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


def archived_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                   min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archive ``pages`` in a new folder, read the archives back by their indexes, and digest the records."""
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    archive_pages(pages, folder, key, url, payload, min_bytes)
    return page_digests(read_records(read_index(spark, folder)), key, pages.schema[key].dataType.simpleString())
