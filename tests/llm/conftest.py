from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def folder(spark, tmp_path):
    """Write small tables and give their folder: ``folder(docs=[(id, text)], labels=[(id, quality, toxic)], pages=[...])``."""

    def make(docs=(), labels=(), pages=()):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs]
        spark.createDataFrame(rows, DOCUMENTS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality long, toxic long").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
        spark.createDataFrame(list(pages), schema).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
        return str(tmp_path)

    return make


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


ODD = [(None, "null id"), (1, None), (2, ""), (3, " \n\t\n"), (4, "same text here"), (4, "same text here"), (5, "same text here"), (6, "x" * 50_000), (7, "é漢 😀 a\x00b"), (2, "other text, same id")]
