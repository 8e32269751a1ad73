"""Key/value metadata of documents: a long table with one value a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as X


def automatic(docs: DataFrame) -> DataFrame:
    """``filename, extension, mime, dir`` rows of ``docs(document_id, path)``."""
    path = F.col("path")
    pairs = {"filename": X.base_name(path), "extension": F.lower(F.expr("substr(_e, 2)")), "mime": X.mime_type(path), "dir": X.directory(path)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])).alias("pair")
    return docs.withColumn("_e", X.extension(path)).select("document_id", rows).select("document_id", "pair.key", "pair.value")


def upsert(*layers: DataFrame) -> DataFrame:
    """One row for each (document_id, key), from the last layer that has it. One shuffle."""
    stacked = reduce(DataFrame.unionByName, [d.select("document_id", "key", "value", F.lit(i).alias("layer")) for i, d in enumerate(layers)])
    return stacked.groupBy("document_id", "key").agg(F.max_by("value", F.struct("layer", "value")).alias("value"))


def value_of(metadata: DataFrame, document_id: int, key: str) -> DataFrame:
    return metadata.where((F.col("document_id") == document_id) & (F.col("key") == key)).select("value")


def entries(metadata: DataFrame, document_id: int) -> DataFrame:
    return metadata.where(F.col("document_id") == document_id).orderBy("key")


def without(metadata: DataFrame, document_id: int, key: str) -> DataFrame:
    return metadata.where(~((F.col("document_id") == document_id) & (F.col("key") == key)))


def as_map(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def _any_pair(filters: dict[str, str]) -> Column:
    return reduce(Column.__or__, [(F.col("key") == k) & (F.col("value") == v) for k, v in filters.items()])


def matching(metadata: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Ids of documents that carry all pairs. The pairs are filters of the scan; one aggregation checks that all are there."""
    found = metadata.where(_any_pair(filters)).groupBy("document_id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(filters)).select("document_id")


def restricted(rows: DataFrame, metadata: DataFrame | None, filters: dict[str, str] | None) -> DataFrame:
    """Rows of documents that carry all pairs; all rows if there are none."""
    if not filters:
        return rows
    if metadata is None:
        raise ValueError("a metadata filter needs the metadata table")
    return rows.join(matching(metadata, filters), "document_id", "left_semi")


def metadata_search(chunks: DataFrame, documents: DataFrame, metadata: DataFrame, filters: dict[str, str], limit: int = 20) -> DataFrame:
    """Chunks of matching documents by document and place; nothing without filters; ``limit <= 0`` is all. The semi-join keeps each
    chunk once, so no texts are compared."""
    rows = chunks.select("chunk_id", "document_id", "chunk_index", "text")
    rows = restricted(rows, metadata, filters) if filters else rows.where("false")
    rows = rows.join(documents.select("document_id", "path", "title"), "document_id")
    rows = rows.select("chunk_id", "document_id", "path", "title", "chunk_index", "text", F.lit(0.0).alias("score"), F.lit("metadata").alias("source"))
    rows = rows.orderBy("document_id", "chunk_index", "chunk_id")
    return rows.limit(limit) if limit > 0 else rows


def numbered(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``rank`` from 1 within ``by``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
