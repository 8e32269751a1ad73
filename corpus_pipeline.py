"""The corpus pipeline: quality rules, line dedup, near-duplicates, personal data, packing.

Each stage works on all rows that the one before it kept and returns the columns of ``documents``, but for the last, which
returns the packed pieces. Between stages the rows are written as Parquet and reread, so a stage's plan starts at a table; what
a stage has read is removed when the next one's table is there.

Cases: null, empty and blank texts have no words and are rejected by the first stage; repeated rows go by line dedup's rule for
rows of one id and then by near_duplicates, which keeps one row of equal texts, that with the least doc_id, ids before null; of
documents of one id and other texts each is judged by itself; very long texts are whole throughout; other columns of documents
go at the first stage; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import removed, table, written
from folio.llm.line_dedup import dedup_lines
from folio.llm.packing import pack_documents
from folio.llm.pii import redact
from folio.llm.pii import train as train_pii
from folio.llm.quality import score_quality
from folio.llm.quality import train as train_quality
from folio.llm.simhash import keep_one

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and with them documents of which nothing is left."""
    rest = dedup_lines(docs)
    return _shaped(rest.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id."""
    return keep_one(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _shaped(redact(docs, train_pii(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages have no equivalent in SQL: trees, fingerprints and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = last, written(docs, name)
            removed(before)
            last = docs
    return docs
