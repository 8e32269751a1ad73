import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.warc_store import op10_warc_store, read_archive, write_archive

PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, "http://c", "é"), (4, None, None), (5, "http://e", ""), (5, "http://e", ""), (None, "http://f\r\nWARC-Type: revisit", "lone")]


def sha1(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark, folder):
    path = folder(pages=PAGES)
    write_archive(spark.read.parquet(f"{path}/pages.parquet"), f"{path}/archive")
    rows = read_archive(spark, f"{path}/archive").collect()
    assert len(rows) == len(PAGES) and spark.read.parquet(f"{path}/archive/payloads").count() == 4
    for r in rows:
        record, payload = bytes(r["record"]), bytes(r["payload"])
        head, _, body = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        assert f"WARC-Payload-Digest: sha1:{sha1(payload.decode())}".encode() in head
        assert body == (payload + b"\r\n\r\n" if r["record_type"] == "response" else b"\r\n\r\n")
        size = len(payload) if r["record_type"] == "response" else 0
        assert f"Content-Length: {size}".encode() in head
        assert b"\r\nWARC-Record-ID: <urn:page:" in head and re.search(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", head)


def test_query(spark, folder):
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in op10_warc_store(spark, folder(pages=PAGES)).collect())
    x, empty = sha1("<p>x</p>"), sha1("")
    assert got == [(0, 4, sha1("lone"), "response", 0), (1, 8, x, "revisit", 2), (2, 8, x, "response", 0), (3, 2, sha1("é"), "response", 0), (4, 0, empty, "revisit", 5), (5, 0, empty, "response", 0), (5, 0, empty, "revisit", 5)]
    assert op10_warc_store(spark, folder()).count() == 0


def test_damage_is_found(spark, folder):
    path = folder(pages=PAGES)
    write_archive(spark.read.parquet(f"{path}/pages.parquet"), f"{path}/archive")
    bad = spark.read.parquet(f"{path}/archive/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(f"{path}/archive2/payloads")
    spark.read.parquet(f"{path}/archive/headers").write.parquet(f"{path}/archive2/headers")
    with pytest.raises(Exception, match="differs"):
        read_archive(spark, f"{path}/archive2").collect()


def test_clashing_columns_and_a_frequent_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    pages = spark.createDataFrame([(i, f"http://{i}", "" if i % 3 else f"<p>{i}</p>", "x", 1) for i in range(120)], "page_id long, url string, html string, digest string, n int")
    write_archive(pages, f"{tmp_path}/a")
    rows = read_archive(spark, f"{tmp_path}/a").collect()
    assert len(rows) == 120 and sum(r["record_type"] == "response" for r in rows) == 41
    assert {r["refers_to"] for r in rows if r["record_type"] == "revisit"} == {119} and all(bytes(r["payload"]) == (b"" if r["page_id"] % 3 else f"<p>{r['page_id']}</p>".encode()) for r in rows)
