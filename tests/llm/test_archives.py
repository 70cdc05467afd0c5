import base64
import hashlib
import random

import pytest

from samewise.llm import archives
from samewise.sources.shared import fresh_path


def brute(pages):
    """pages: (page_id, url, html)."""
    by_payload = {}
    for page, _, html in pages:
        by_payload.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        largest = max((x for x in by_payload[html or ""] if x is not None), default=None)
        again = largest is not None and page != largest
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", largest if again else None))
    return sorted(map(repr, out))


def through(spark, pages):
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    archives.write_arc(pages, arc)
    archives.convert(spark, arc, warc)
    return archives.read_warc(spark, warc).collect()


def answers(rows):
    return sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(archives, "PER_FILE", 3000)
    rng = random.Random(5)
    odd = [None, "", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "filedesc://x 0 0 0 9\n", "é\x00ü" * 50, "http://a 0.0.0.0 2 text/html 5\n", "\n", "x" * 300_000]
    pages = [(i, rng.choice([None, "http://a/b c", "", "http://ü/"]), rng.choice(odd) if i % 3 else f"<p>{i}</p>\n" * (i % 7)) for i in range(300)]
    pages += [(None, None, "only"), (None, "u", "only"), (None, "u", ""), *pages[40:44]]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    rows = through(spark, frame)
    assert answers(rows) == brute(pages)
    assert through(spark, frame.where("false")) == []


def test_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = through(spark, frame)
    assert answers(rows) == brute([tuple(r) for r in frame.collect()])
    by_page = {r.page_id: r.record_id for r in rows}
    assert all(r.refers_to_record == by_page.get(r.refers_to) for r in rows)
    assert len({r.record_id for r in rows}) == len(rows) and all(len(r.warc_date) == 20 for r in rows)


def test_both_versions_and_errors():
    one = archives.version_block(1) + b"http://a 1.2.3.4 19970102030405 text/html 3\nabc\n"
    two = archives.version_block(2) + b"http://b 1.2.3.4 1998 text/html 200 - - 0 f 4\nab\nc\n"
    records = list(archives.arc_records(one + two))
    assert [(r.fields["URL"], r.body) for r in records] == [("http://a", b"abc"), ("http://b", b"ab\nc")]
    assert records[1].fields["Result-code"] == "200"
    assert [archives.iso_date(r.fields["Archive-date"]) for r in records] == ["1997-01-02T03:04:05Z", "1998-01-01T00:00:00Z"]
    for bad in (one[:-3], b"http://a 1 2 3 4\n", archives.version_block(1) + b"too few\n"):
        with pytest.raises(ValueError, match="cut short|header line"):
            list(archives.arc_records(bad))


def test_files_are_bounded_by_their_bytes(spark, monkeypatch):
    """Many small pages and then many large ones in one partition."""
    import gzip

    monkeypatch.setattr(archives, "PER_FILE", 1 << 20)
    pages = [(i, "http://a/", "x" * 10) for i in range(0, 4000, 2)] + [(i, "http://a/", f"{i} " + "y" * 200_000) for i in range(4000, 4120, 2)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    arc = fresh_path(spark, "arc")
    archives.write_arc(frame, arc)
    sizes = [len(gzip.decompress(r.content)) for r in archives.read_files(spark, f"{arc}/v*").collect()]
    assert len(sizes) > 10 and max(sizes) < (1 << 20) + 210_000 and sum(sizes) > 60 * 200_000


def test_records_of_a_file(spark):
    warc = fresh_path(spark, "warc")
    arc = fresh_path(spark, "arc")
    archives.write_arc(spark.createDataFrame([(2, "http://a/", "same"), (4, "http://b/", "same"), (5, None, "other")], "page_id long, url string, html string").coalesce(1), arc)
    archives.convert(spark, arc, warc)
    import gzip

    heads = [head for r in archives.read_files(spark, warc).collect() for head, _ in archives.warc_records(gzip.decompress(r.content))]
    kinds = [h["warc-type"] for h in heads]
    assert kinds.count("warcinfo") >= 1 and kinds.count("revisit") == 1 and kinds.count("response") == 2
    revisit, response = (next(h for h in heads if h["warc-type"] == k and h.get("warc-target-uri") in ("http://a/", "http://b/")) for k in ("revisit", "response"))
    assert revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-refers-to-target-uri"] == "http://b/" and revisit["warc-refers-to-date"] == response["warc-date"]
