"""The given tables as a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.chunking import chunk_documents
from folio.operators.keyword import StoredIndex, Texts, build_index, read_index, write_index
from folio.operators.metadata import automatic, upsert
from folio.sources.scratch import scratch_folder

STAMP = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of() -> F.Column:
    return F.concat(F.lit("/kb/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("path", path_of())
    path, at = F.col("path"), F.to_timestamp(F.lit(STAMP))
    return rows.select(F.col("doc_id").alias("document_id"), "path", X.text_hash(F.col("text")).alias("sha256"), X.title(path).alias("title"), X.mime_type(path).alias("mime_type"), at.alias("created_at"), at.alias("updated_at"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of documents that results show; the text is not read for them."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), path_of().alias("path"))
    return rows.withColumn("title", X.title(F.col("path")))


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk, for queries whose results SQL can check."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text", X.count_tokens(F.col("text")).alias("token_count"))


def real_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the texts, numbered so that SQL can give the same ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunk_documents(spread(docs)).withColumn("chunk_id", F.col("document_id") * 1_000_000 + F.col("chunk_index"))


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as chunks of the document with their number."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")


def text_and_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return whole_chunks(spark, sf_dir).join(vectors, "chunk_id", "left")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic keys, ``lang`` and ``source``, and the labels of those that have them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source", path_of().alias("path"))
    own = docs.select("document_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("lang", "source")])).alias("p")).select("document_id", "p.*")
    marks = table(spark, sf_dir, "labels")
    marks = marks.select(F.col("doc_id").alias("document_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("quality", "toxic")])).alias("p")).select("document_id", "p.*")
    return upsert(automatic(docs.select("document_id", "path")), own, marks)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their files make fewer tasks than there are; a large table stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(spread(whole_chunks(spark, sf_dir).select("chunk_id", "document_id", "text")))


def stored_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The index written once, as searches use it."""
    folder = scratch_folder(spark, "index")
    write_index(index(spark, sf_dir), folder, 16)
    return read_index(spark, folder)


def texts(spark: SparkSession, sf_dir: str) -> Texts:
    """The same without an index: one batch of queries is answered by scanning, which costs less than to index first."""
    return Texts(spread(whole_chunks(spark, sf_dir).select("chunk_id", "document_id", "text")))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each benchmark passage: its first word, and its next two as a phrase."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), asked(F.col("text")).alias("text"))


def asked(text: F.Column) -> F.Column:
    words = F.split(text, " ")
    return F.concat(F.get(words, F.lit(0)), F.lit(" "), F.get(words, F.lit(1)), F.lit("-"), F.get(words, F.lit(2)))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose number is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose number is divisible by 20: their first words, and the vector of those that have one."""
    words = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), asked(F.col("text")).alias("text"))
    return words.join(vector_queries(spark, sf_dir), "query_id", "left")
