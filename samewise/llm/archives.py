"""Legacy ARC archives: writing, parsing, and conversion to WARC with revisits.

An ARC file starts with a version block that names the fields of all header lines: version 1 has URL, IP address, date, type and length,
version 2 also result code, checksum, location, offset and file name. Every record is a header line and as many bytes as it declares.
The converter reads the version, parses header lines by its fields, takes the declared bytes, splits the HTTP head from the payload, and
makes what WARC wants: a record id from URL, date and digest, a date in ISO form, SHA-1 digests in base 32, and the type. Of records with
equal payloads the one with the largest id is the response, and the others revisit it without repeating the payload.

Archives are files in the shared folder, written by Spark's text writer with the record separator as its line separator, so they lie
wherever Spark can write, and read by its binary reader. A file is closed as soon as it has PER_FILE bytes or more, so it holds less than that
and one record, which bounds what a task holds. Files are gzip streams, one each: the text writer has no members by record.
Payloads are not shuffled unless payloads held twice are too many to broadcast.

Which record is the largest of its payload is found by an aggregation over digests, which combines before the shuffle; only digests held
twice are joined back, and adaptive execution splits that join where one payload is held by very many.

Edge cases: NULL html is an empty payload; a NULL id or URL is left out of the record's head and comes back NULL; rows that repeat the
largest id of their payload are all responses, for they cannot be told apart; in a payload whose ids are all NULL every record is
a response; record separators inside payloads do no harm, since lengths are declared; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.sources.shared import fresh_path, remove, written

PER_FILE = 16 << 20
LEAST_REVISIT = 0  # bytes of a payload from which on it is revisited
PARSED = "url string, date string, page_id long, payload binary, size long, payload_digest string"
_PARSED = pa.schema([("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()), ("size", pa.int64()), ("payload_digest", pa.string())])
ANSWERED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_date string, record_id string, target_uri string, refers_to_record string"
_ANSWERED = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("warc_date", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to_record", pa.string())])

# The version blocks of the format, each with the names of its header fields.
ARC_V1 = "URL IP-address Archive-date Content-type Archive-length"
ARC_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_LINE = b"\n"
_HEAD_END = b"\r\n\r\n"


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    body: bytes


def version_block(version: int, name: str = "samewise.arc") -> bytes:
    fields = {1: ARC_V1, 2: ARC_V2}[version]
    body = f"{version} 0 samewise\n{fields}\n".encode()
    own = {1: f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {len(body)}", 2: f"filedesc://{name} 0.0.0.0 19960101000000 text/plain 200 - - 0 {name} {len(body)}"}[version]
    return own.encode() + _LINE + body


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, after its version block. Blank lines between records are skipped."""
    fields: list[str] | None = None
    at = 0
    while at < len(data):
        end = data.find(_LINE, at)
        if end < 0:
            end = len(data)
        line, at = data[at:end].strip(), end + 1
        if not line:
            continue
        values = line.decode("utf-8", "replace").split(" ")
        if line.startswith(b"filedesc://"):
            block = data[at : at + int(values[-1])]
            version, names = block.split(_LINE)[:2]
            fields = names.decode().split(" ")
            if version[:1] not in (b"1", b"2") or len(fields) != {b"1": 5, b"2": 10}[version[:1]]:
                raise ValueError(f"not a version block: {block[:80]!r}")
            at += int(values[-1])
            continue
        if fields is None or len(values) != len(fields):
            raise ValueError(f"not a header line: {line[:80]!r}")
        size = int(values[-1])
        if at + size > len(data):
            raise ValueError(f"a record of {size} bytes is cut short")
        yield ArcRecord(dict(zip(fields, values, strict=True)), data[at : at + size])
        at += size


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso_date(date: str) -> str:
    """The 14-digit date of ARC as WARC has it; shorter ones are filled up."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _head_values(head: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, v in pairs}


def arc_text(page: Column, url: Column, html: Column, version: Column, date: Column) -> Column:
    """An ARC record as text: the header line of its version, then the HTTP head and the payload."""
    payload = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.coalesce(F.concat(F.lit("X-Page-Id: "), page.cast("string"), F.lit("\r\n")), F.lit("")), F.lit("\r\n"))
    size = (F.octet_length(head) + F.octet_length(payload)).cast("string")
    where = F.coalesce(F.regexp_replace(url, r"[\x00-\x20]", "%20"), F.lit("-"))
    where = F.when(where == "", "-").otherwise(where)
    more = F.when(version == 2, F.lit(" 200 - - 0 samewise.arc")).otherwise("")
    return F.concat(where, F.lit(" 0.0.0.0 "), date, F.lit(" text/html"), more, F.lit(" "), size, F.lit("\n"), head, payload)


def packed(texts: Iterator[str], separator: str, block: Callable[[str], str], limit: int) -> Iterator[str]:
    """The texts of whole files: a block that opens the file, made from its first record, and records until they have ``limit`` bytes."""
    parts: list[str] = []
    held = 0
    for text in texts:
        parts.append(text if parts else block(text) + text)
        held += len(text.encode())
        if held >= limit:
            yield separator.join(parts)
            parts, held = [], 0
    if parts:
        yield separator.join(parts)


def write_text(records: DataFrame, column: Column, path: str, separator: str, block: Callable[[str], str]) -> None:
    """Write one text column to gzip files of bounded size, in the partitions as they are; the separator follows each value."""
    limit = PER_FILE

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in packed((x.as_py() for batch in batches for x in batch.column(0)), separator, block, limit):
            yield pa.RecordBatch.from_arrays([pa.array([text])], ["file"])

    whole = records.select(column.alias("record")).mapInArrow(files, "file string")
    whole.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per archive file, a task each few."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages as ARC files, those with even ids under path/v2 in version 2 and the others under path/v1 in version 1. A version block
    opens each file."""
    number = F.coalesce(F.col(page_id).cast("long"), F.lit(0))
    date = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.pmod(number, F.lit(600_000_000))), "yyyyMMddHHmmss")
    even = F.pmod(number, F.lit(2)) == 0
    for version, rows in ((1, pages.where(~even)), (2, pages.where(even))):
        opening = version_block(version).decode()
        write_text(rows, arc_text(F.col(page_id), F.col(url), F.col(html), F.lit(version), date), f"{path}/v{version}", "\n", lambda _, opening=opening: opening)


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the ARC files under path/v1 and path/v2: url, date, page_id, payload (or NULL), size, payload_digest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _parsed(gzip.decompress(content.as_py()), with_payload)

    return read_files(spark, f"{path}/v*").mapInArrow(parse, PARSED)


def _parsed(data: bytes, with_payload: bool, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for record in arc_records(data):
        head, _, payload = record.body.partition(_HEAD_END)
        page = _head_values(head).get("x-page-id")
        url = record.fields["URL"]
        rows.append((None if url == "-" else url, record.fields["Archive-date"], None if page is None else int(page), payload if with_payload else None, len(payload), digest32(payload)))
        held += len(payload)
        if held > most:
            yield _batch(rows, _PARSED)
            rows, held = [], 0
    yield _batch(rows, _PARSED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def with_type(records: DataFrame, digests: DataFrame) -> DataFrame:
    """Add refers_to, refers_url and refers_date to records: those of the largest page of their payload, NULL for that page itself and for
    payloads held once.

    ``digests`` has page_id, url, date, payload_digest and size of the same records.
    """
    top = F.max(F.struct("page_id", "url", "date")).alias("top")
    big = digests.where(F.col("size") >= LEAST_REVISIT).groupBy("payload_digest").agg(top, F.count(F.lit(1)).alias("n"))
    shared = written(big.where("n > 1 AND top.page_id IS NOT NULL").select("payload_digest", "top"), "archive-shared")
    both = records.join(shared, "payload_digest", "left")
    again = ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    return both.select(*records.columns, *[F.when(again, F.col(f"top.{c}")).alias(n) for c, n in (("page_id", "refers_to"), ("url", "refers_url"), ("date", "refers_date"))])


def _iso(date: str) -> Column:
    return F.date_format(F.to_timestamp(date, "yyyyMMddHHmmss"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _urn(url: str, date: str, page: str) -> Column:
    """A UUID from URL, date, page and digest."""
    marks = F.md5(F.concat_ws(" ", F.coalesce(url, F.lit("-")), date, F.coalesce(F.col(page).cast("string"), F.lit("-")), "payload_digest").cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(marks, a, n)]], F.lit(">"))


def warc_info(first: str) -> str:
    """The record that opens a file, its id made from the file's first record, and its end."""
    body = "software: samewise\r\nformat: WARC File Format 1.1\r\n"
    mark = uuid.UUID(hashlib.md5(b"warcinfo " + first.encode()).hexdigest())
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{mark}>\r\nWARC-Date: 1996-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


def warc_text() -> Column:
    """A WARC record as text. The id is a UUID from URL, date, page and digest, so a repeated conversion gives the same."""
    again = F.col("refers_to").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    page = line("X-Page-Id", F.col("page_id").cast("string"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), page, F.lit("\r\n"))
    payload = F.when(again, F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn("url", "date", "page_id")),
        line("WARC-Date", _iso("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(again, _urn("refers_url", "refers_date", "refers_to"))),
        line("WARC-Refers-To-Target-URI", F.when(again, F.col("refers_url"))),
        line("WARC-Refers-To-Date", F.when(again, _iso("refers_date"))),
        line("X-Payload-Length", F.octet_length("payload").cast("string")),
        line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.octet_length(payload)).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, http, payload)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header values, block) of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"not a record: {data[at : at + 40]!r}")
        end = data.index(_HEAD_END, at) + len(_HEAD_END)
        head = _head_values(data[at:end])
        size = int(head["content-length"])
        yield head, data[end : end + size]
        at = end + size
        if data[at : at + 4] != _HEAD_END:
            raise ValueError("a record does not end where its length says")
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What the WARC files say of each record. The payload of a response is held against its digest and length."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in warc_records(gzip.decompress(content.as_py())):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(_HEAD_END)
                    digest, size, kind = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]), head["warc-type"]
                    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
                        raise ValueError(f"{head['warc-record-id']}: the payload is not the one of its digest")
                    page, refers = _head_values(http).get("x-page-id"), head.get("x-refers-to-page")
                    uuid.UUID(head["warc-record-id"][1:-1])
                    rows.append((None if page is None else int(page), size, digest, kind, None if refers is None else int(refers), head["warc-date"], head["warc-record-id"], head.get("warc-target-uri"), head.get("warc-refers-to")))
                yield _batch(rows, _ANSWERED)

    return read_files(spark, path).mapInArrow(parse, ANSWERED)


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Write the records of ARC files as WARC files, with revisits."""
    records = read_arc(spark, arc)
    digests = written(read_arc(spark, arc, with_payload=False).drop("payload"), "archive-digests")
    write_text(with_type(records, digests), warc_text(), warc, "\r\n\r\n", warc_info)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, through ARC files into WARC files and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    remove(spark, arc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_QUINTETS = "list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1))"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, payload_bytes, array_to_string({_QUINTETS}, '') AS payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to FROM d
"""
