import base64
import hashlib

import pytest
from frames import SF, texts

from tabulens.llm.queries import op6_warc
from tabulens.llm.warc import archived_pages, read_archives, unchunked, write_archives


def expected(rows, least=0):
    first = {}
    for key, payload in sorted(rows):
        if len(payload.encode()) >= least:
            first.setdefault(payload, key)
    out = {}
    for key, payload in rows:
        digest = base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        to = first.get(payload, key)
        out[key] = (len(payload.encode()), digest, "response" if to == key else "revisit", None if to == key else to)
    return out


def told(frame):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()}


def test_query_against_brute_force(spark):
    assert told(op6_warc(spark, SF)) == expected(texts("pages", "page_id, html"))


ROWS = [
    (1, "http://a/ x\r\ny", "<p>é</p>"),
    (2, None, "<p>é</p>"),
    (3, "http://b/", None),
    (4, "http://c/", ""),
    (5, "http://d/", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx\r\n\r\n"),
    (6, "", "y" * 600_000),
    (7, "http://e/", "y" * 600_000),
]


def test_round_trip_of_odd_pages(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "c", 1) for r in ROWS], "page_id long, url string, html string, payload string, id int")
    plain = [(k, html or "") for k, _, html in ROWS]
    assert told(archived_pages(spark, pages, str(tmp_path / "all"))) == expected(plain)
    some = archived_pages(spark, pages, str(tmp_path / "some"), min_bytes=100)
    assert told(some) == expected(plain, 100)
    found = {r.page_id: r.payload for r in read_archives(spark, str(tmp_path / "all")).collect()}
    assert found["5"] == ROWS[4][2] and found["2"] is None and found["3"] == ""


def test_predicates_reach_the_reader(spark, tmp_path):
    write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string"), str(tmp_path / "w"))
    records = read_archives(spark, str(tmp_path / "w"))
    one = records.where("record_type = 'revisit' AND page_id IN ('2', '7')")
    assert sorted(r.page_id for r in one.collect()) == ["2", "7"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert read_archives(spark, str(tmp_path / "w"), payload=False).where("payload IS NOT NULL").count() == 0
    assert records.count() == 7
    assert records.where("target_uri = 'http://a/%20x%20%20y'").count() == 1


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archived_pages(spark, pages, str(tmp_path / "w")).count() == 0


def test_a_torn_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="ends inside"):
        read_archives(spark, str(tmp_path)).collect()


def test_records_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\nContent-Type: text/html\n\nhello world"
    parts = b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    out = b""
    for k, block in enumerate((http, parts)):
        head = f"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <{k}>\r\ncontent-length: {len(block)}\r\ncontent-type: Application/http\r\n\r\n"
        out += head.encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(out)
    plain = {r.record_id: r.payload for r in read_archives(spark, str(tmp_path)).collect()}
    assert plain == {"<0>": "hello world", "<1>": "5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"}
    found = read_archives(spark, str(tmp_path), unchunk=True).where("record_type = 'response'")
    assert [(r.payload, r.payload_bytes) for r in found.collect()] == [("hello world", 11)] * 2
    assert unchunked(b"zz\r\nno") == b"zz\r\nno"
