"""Operator 10: a content-addressed WARC archive.

Two tables make the archive: ``payloads`` holds each distinct payload once under its SHA-256, ``headers`` holds the exact
header bytes of every record with the digest of its payload. A record is its header followed, for responses, by the payload
that a join on the digest finds; reading checks every payload against its digest and every header's length against it.
Of the records with equal payloads the one with the largest page_id is the response, the others are revisits of it.

Limits: the tables have no capture time, so ``WARC-Date`` is the time of writing, one for the archive; payloads are bare HTML
without an HTTP head, and so are the record blocks.

Cases: a null html counts as empty bytes; a null url leaves the target line out; a null page_id is smaller than all others
and has the record id ``urn:page:null``; of repeated rows, or of equal page_ids with equal payloads, one is the response and the rest
revisit it; an empty table gives an empty archive; very long pages are single payloads like others; only page_id, url and html are used, other columns may have any name.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import removed, shared_dir, table, unskewed, written
from folio.sources.scratch import until_exit

#: Digits of the two base-32 alphabets, and WARC's fixed header lines.
BASE32_NUMBERS, BASE32_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base-32 SHA-1: each 5 hex digits are 4 base-32 digits."""
    digest = F.sha1(data)
    part = lambda i: F.lpad(F.conv(digest.substr(i * 5 + 1, F.lit(5)), 16, 32), 4, "0")
    return F.translate(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), part), ""), BASE32_NUMBERS, BASE32_LETTERS)


def write_archive(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as ``path/payloads`` and ``path/headers``."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    facts = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), sha1_base32(F.col("payload")).alias("sha1"))
    records = facts.groupBy("page_id", "url", "digest", "size", "sha1").agg(F.count("*").alias("copies"))
    response = written(records.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("response"), F.count("*").alias("n")), "responses")
    # one digest may be that of a third of the pages
    records = unskewed(records, response, ["digest"], ["page_id", "url"]).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    first = (F.col("copy") == 1) & F.struct("page_id", "url").eqNullSafe(F.col("response"))
    # a literal, so that a task that is repeated writes the same bytes
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))
    maybe = lambda text: F.coalesce(text, F.lit(""))  # noqa: E731  concat is null if a part is
    urn = lambda page: (F.lit("<urn:page:"), page.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        line("WARC-Record-ID", *urn(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))),
        line("WARC-Date", F.lit(stamp)),
        maybe(line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))),
        F.when(first, "").otherwise(F.concat(maybe(line("WARC-Refers-To", *urn(F.col("response.page_id")))), line("WARC-Profile", F.lit(PROFILE)))),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(first, F.col("size")).otherwise(0).cast("string")),
        F.lit("\r\n"),
    )
    records.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    removed(response)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: ``page_id, record_type, refers_to, payload_bytes, payload_digest, payload, record``.

    ``record`` is the whole WARC record; ``payload`` is the full payload of revisits too. A payload that does not have its
    digest, or a header that disagrees with its payload, raises an error.
    """
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    headers = spark.read.schema("page_id long, digest string, header binary").parquet(f"{path}/headers")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.octet_length("payload").cast("long"))
    payloads = payloads.select("digest", "payload", F.coalesce(sound, F.raise_error(F.lit("payload differs from its digest")).cast("long")).alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    parsed = headers.select(
        "page_id",
        "digest",
        "header",
        field("WARC-Type", "(response|revisit)").alias("record_type"),
        F.nullif(field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>"), F.lit("")).cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("stated"),
    )
    joined = unskewed(parsed, payloads, ["digest"], ["page_id", "header"], counts=headers.groupBy("digest").agg(F.count("*").alias("n")))
    agreed = F.when(F.col("stated") == F.col("payload_digest"), F.col("payload_digest"))
    tail = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    return joined.select(
        "page_id",
        "record_type",
        "refers_to",
        "payload_bytes",
        F.coalesce(agreed, F.raise_error(F.lit("header differs from its payload")).cast("string")).alias("payload_digest"),
        "payload",
        F.when(F.col("record_type") == "response", F.concat("header", "payload", tail)).otherwise(F.concat("header", tail)).alias("record"),
    )


def op10_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = until_exit(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH r AS (
  SELECT page_id, url, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, strlen(p)::BIGINT AS payload_bytes,
    translate(array_to_string(list_transform(range(8), lambda i: lpad(to_base(('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT, 32), 4, '0')), ''),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    max(page_id) OVER (PARTITION BY p) AS top
  FROM r
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""
