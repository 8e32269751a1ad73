"""Top-k of many queries, and looking up what the best rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_K = 5
#: Rows of a few numbers and short strings up to which a side that is known to be no larger is broadcast.
BROADCAST_ROWS = 500_000


def effective_k(*wanted: int | None) -> int:
    """The first positive of the caller's, the template's and the default k."""
    return next((k for k in wanted if k and k > 0), DEFAULT_K)


def top(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query with their rank from 1; equal scores by chunk_id. Spark prunes before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "document_id", "score")


def bounded(few: DataFrame, most: int | None) -> DataFrame:
    """``few`` with a broadcast hint if it has at most ``most`` rows, and those are few enough; else the join shuffles."""
    return F.broadcast(few) if most is not None and most <= BROADCAST_ROWS else few


def hydrated(ranks: DataFrame, chunks: DataFrame, documents: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """Results with text, path and title; ids that have gone are dropped. ``most`` bounds the rows of ``ranks``.

    The corpus is joined only after the top-k, first for the short columns; a bounded number of results goes to it, and no text moves.
    """
    rows = documents.select("document_id", "path", "title").join(bounded(ranks, most), "document_id")
    rows = chunks.select("chunk_id", "chunk_index", "text").join(bounded(rows, most), "chunk_id")
    return rows.select("query_id", "rank", "chunk_id", "document_id", "path", "title", "chunk_index", "text", "score", F.lit(source).alias("source"))
