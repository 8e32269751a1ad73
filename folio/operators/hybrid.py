"""Reciprocal rank fusion of vector and keyword search, and retrieval with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import citation
from folio.operators.keyword import StoredIndex, Texts, keyword_ranks
from folio.operators.ranking import effective_k, hydrated, top
from folio.operators.vector import vector_ranks

#: Constant of reciprocal rank fusion.
RRF = 60


def fused(*legs: DataFrame) -> DataFrame:
    """``query_id, chunk_id, document_id, score``: the sum of ``1 / (60 + rank)`` over the legs."""
    stacked = legs[0].select("query_id", "chunk_id", "document_id", "rank")
    for leg in legs[1:]:
        stacked = stacked.unionByName(leg.select("query_id", "chunk_id", "document_id", "rank"))
    return stacked.groupBy("query_id", "chunk_id", "document_id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))


def hybrid_search(chunks: DataFrame, documents: DataFrame, index: DataFrame | StoredIndex | Texts, queries: DataFrame, top_k: int = 5, min_score: float = 0.0, metadata: DataFrame | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """Both legs at twice the ``top_k`` for ``queries(query_id, text, vec)``; ``min_score`` is of fused scores, if positive."""
    k = effective_k(top_k)
    rows = fused(vector_ranks(chunks, queries, 2 * k, 0.0, metadata, filters), keyword_ranks(index, queries, 2 * k, metadata, filters))
    if min_score > 0:
        rows = rows.where(F.col("score") >= min_score)
    return hydrated(top(rows, k), chunks, documents, "hybrid", k * queries.count())


def retrieve(chunks: DataFrame, documents: DataFrame, index: DataFrame | StoredIndex | Texts, queries: DataFrame, top_k: int = 5, metadata: DataFrame | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """Hybrid search with the citation of each chunk."""
    found = hybrid_search(chunks, documents, index, queries, top_k, 0.0, metadata, filters)
    return found.withColumn("citation", citation(F.col("path"), F.col("chunk_index")))
