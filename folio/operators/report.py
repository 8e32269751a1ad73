"""Statistics, listings, health and formatted results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import preview, strip_control
from folio.operators.keyword import corpus_statistics
from folio.sources.store import Store


def kb_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, embedded chunks and characters of text. Two scans, each aggregated where it is read."""
    docs = documents.agg(F.count("*").alias("total_documents"))
    rows = chunks.agg(F.count("*").alias("total_chunks"), F.count("embedding").alias("embedded_chunks"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("total_size_bytes"))
    # two single rows
    return docs.join(F.broadcast(rows))


def stored_stats(store: Store) -> DataFrame:
    """The same row, and the words of the index, of a stored knowledge base: sums over the lines of its log, no table is read."""
    n = store.numbers()
    row = (n["documents"], n["chunks"], n["embedded"], n["chars"], n["words"])
    return store.spark.createDataFrame([row], "total_documents long, total_chunks long, embedded_chunks long, total_size_bytes long, total_words long")


def list_documents(documents: DataFrame, chunks: DataFrame, limit: int = 0) -> DataFrame:
    """``document_id, path, title, chunks, updated_at`` by id; 0 is all."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    rows = documents.join(counts, "document_id", "left").select("document_id", "path", "title", F.coalesce("chunks", F.lit(0)).alias("chunks"), "updated_at").orderBy("document_id")
    return rows.limit(limit) if limit > 0 else rows


def health(documents: DataFrame, chunks: DataFrame, metadata: DataFrame, index: DataFrame, dimension: int = 0) -> DataFrame:
    """``check, value, ok``: counts, dimensions, orphans, and whether the index is in step with the chunks."""
    ids = documents.select("document_id")
    # lengths of embeddings are a handful of values
    sizes = chunks.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).count()
    dims = sizes.agg(F.count("*").alias("n"), F.min("d").alias("d"))
    fits = (F.col("n") == 0) | ((F.col("n") == 1) & ((F.lit(dimension) <= 0) | (F.col("d") == dimension)))
    orphans = lambda rows, name: rows.join(ids, "document_id", "left_anti").agg(F.count("*").alias("v")).select(F.lit(name).alias("check"), "v", (F.col("v") == 0).alias("ok"))
    counted = lambda rows, name: rows.agg(F.count("*").alias("v")).select(F.lit(name).alias("check"), "v", F.lit(True).alias("ok"))
    indexed = corpus_statistics(index).select("chunks")
    gap = chunks.agg(F.count("*").alias("c")).join(F.broadcast(indexed)).select(F.lit("chunks_not_indexed").alias("check"), (F.col("c") - F.col("chunks")).alias("v"), (F.col("c") == F.col("chunks")).alias("ok"))
    parts = [
        counted(documents, "documents"),
        counted(chunks, "chunks"),
        dims.select(F.lit("embedding_dimensions").alias("check"), F.col("n").alias("v"), fits.alias("ok")),
        orphans(chunks, "orphan_chunks"),
        orphans(metadata, "orphan_metadata"),
        orphans(index, "orphan_postings"),
        gap,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("v", "value")


#: Keys of the JSON that results are written as.
SEARCH_KEYS = {"chunk_id": "ChunkID", "document_id": "DocumentID", "path": "Path", "title": "Title", "chunk_index": "ChunkIndex", "text": "Text", "score": "Score", "source": "Source"}
LIST_KEYS = ["path", "title", "chunks", "updated_at"]
STATS_KEYS = ["total_documents", "total_chunks", "embedded_chunks", "total_size_bytes"]


def as_json(rows: DataFrame, keys: dict[str, str] | list[str], *keep: str) -> DataFrame:
    """``rows`` as one JSON string each (``json``), after the columns ``keep``; write it with ``df.write.text``."""
    names = keys if isinstance(keys, dict) else {k: k for k in keys}
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kinds = dict(rows.dtypes)
    fields = [(stamp(F.col(c)) if kinds[c] == "timestamp" else F.col(c)).alias(n) for c, n in names.items()]
    return rows.select(*keep, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def as_lines(results: DataFrame, preview_chars: int = 120) -> DataFrame:
    """``query_id, rank, line``: results as text, with a preview free of control characters."""
    head = F.format_string("[%d] score=%.4f  %s §%d", "rank", "score", "path", "chunk_index")
    return results.select("query_id", "rank", F.concat(head, F.lit("\n    "), preview(strip_control(F.col("text")), preview_chars)).alias("line"))
