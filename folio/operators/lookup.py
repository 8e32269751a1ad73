"""Single documents and their chunks. The filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_by_path(documents: DataFrame, path: str) -> DataFrame:
    return documents.where(F.col("path") == path)


def document_by_hash(documents: DataFrame, sha256: str) -> DataFrame:
    """The first document, by id, with this content."""
    return documents.where(F.col("sha256") == sha256).orderBy("document_id").limit(1)


def first_by_hash(documents: DataFrame) -> DataFrame:
    """The same for every content at once: one row a hash, aggregated before it moves."""
    rest = [c for c in documents.columns if c not in ("sha256", "document_id")]
    first = documents.groupBy("sha256").agg(F.min(F.struct("document_id", *rest)).alias("d"))
    return first.select("sha256", "d.*")


def chunks_of(chunks: DataFrame, document_id: int) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``document_id, chunks`` of every document, 0 where there are none."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return documents.select("document_id").join(counts, "document_id", "left").select("document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))
