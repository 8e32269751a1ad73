"""What an ingest changes: new and changed files, replaced chunks, deleted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(files: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """``files(path, sha256, ...)`` with ``change`` (new, changed, forced, unchanged) and the ``document_id`` they have."""
    known = documents.select("path", F.col("document_id").alias("known_id"), F.col("sha256").alias("known_sha"))
    rows = files.join(known, "path", "left")
    same = F.col("sha256") == F.col("known_sha")
    change = F.when(F.col("known_id").isNull(), "new").when(~same | F.col("known_sha").isNull(), "changed").otherwise("forced" if force else "unchanged")
    document_id = F.coalesce("known_id", F.xxhash64("path"))
    return rows.withColumn("change", change).withColumn("document_id", document_id).drop("known_id", "known_sha")


def replaced(old: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``old`` but for the documents in ``done``, whose rows come from ``new``; other new rows are left out."""
    ids = done.select("document_id")
    kept = old.join(ids, "document_id", "left_anti")
    return kept.unionByName(new.join(ids, "document_id", "left_semi").select(*old.columns))


def repeated_content(documents: DataFrame) -> DataFrame:
    """Groups of documents with equal content: ``sha256, n, first_path, last_path``."""
    return documents.groupBy("sha256").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).where("n > 1")


def delete_documents(tables: dict[str, DataFrame], paths: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the documents of ``paths(path)``, and what became of each path: ``path, status, chunks``.

    Chunks, metadata and postings go with a document, its extracted text too unless another document has the same content.
    Raw copies stay.
    """
    documents = tables["documents"]
    asked = paths.select("path").distinct()
    gone = documents.join(asked, "path", "left_semi").select("document_id", "path", "sha256", "mime_type")
    out = dict(tables)
    for name in ("documents", "chunks", "metadata", "postings"):
        if name in tables:
            out[name] = tables[name].join(gone.select("document_id"), "document_id", "left_anti")
    if "extracted" in tables:
        keys = ["sha256", "mime_type"]
        unused = gone.select(*keys).join(out["documents"].select(*keys), keys, "left_anti").distinct()
        out["extracted"] = tables["extracted"].join(unused, keys, "left_anti")
    removed = tables["chunks"].join(gone.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("chunks"))
    report = asked.join(gone.select("path", "document_id"), "path", "left").join(removed, "document_id", "left")
    status = F.when(F.col("document_id").isNull(), "not found").otherwise("deleted")
    return out, report.select("path", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
