"""Tables of a knowledge base. Types are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

DOCUMENTS = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("start_byte", T.IntegerType()),
        T.StructField("end_byte", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

METADATA = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

EXTRACTED = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("mime_type", T.StringType()), T.StructField("text", T.StringType())])

RAW = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("content", T.BinaryType())])

POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("chunk_id", T.LongType()), T.StructField("document_id", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("dl", T.IntegerType())])

TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "metadata": METADATA, "extracted": EXTRACTED, "raw": RAW, "postings": POSTINGS}
#: Tables of contents by their hash: rows are added to them and never changed. The others belong to documents.
APPENDED = ("extracted", "raw")
#: What identifies a row of each table.
KEYS = {"documents": ["path"], "chunks": ["document_id", "chunk_index"], "metadata": ["document_id", "key"], "extracted": ["sha256", "mime_type"], "raw": ["sha256", "ext"], "postings": ["term", "chunk_id"]}
