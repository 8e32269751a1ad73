"""Source files: reading a folder, extracting text by MIME type, and content-addressed stores."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.html import page_text

#: Extensions that are read, and the largest file.
EXTENSIONS = [".md", ".txt", ".pdf", ".html", ".htm"]
MOST_BYTES = 100 << 20

Extractor = Callable[[bytes], str]


def read_files(spark: SparkSession, folder: str, with_content: bool = True) -> DataFrame:
    """``path, modificationTime, length, content`` of the known files below ``folder``, whatever the case of their extension.

    Without ``content`` files are only listed. Files whose name starts with '.' or '_' are not seen by Spark.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower(X.extension(F.col("path"))).isin(EXTENSIONS))
    files = files.withColumn("path", X.local_path(F.col("path")))
    return files if with_content else files.drop("content")


def described(files: DataFrame) -> DataFrame:
    """``files`` with ``sha256`` of the bytes, ``title``, ``mime_type`` and ``error`` (set for files that are too large)."""
    path = F.col("path")
    too_large = F.when(F.col("length") > MOST_BYTES, F.format_string("file has %d bytes, more than %d", "length", F.lit(MOST_BYTES)))
    return files.select("*", X.content_hash(F.col("content")).alias("sha256"), X.title(path).alias("title"), X.mime_type(path).alias("mime_type"), too_large.alias("error"))


def _helper_text(extractors: dict[str, Extractor]):
    """Text and error by a Python helper for the MIME types that need one; a crash is that row's error."""
    kind = pa.struct([("text", pa.string()), ("error", pa.string())])

    @F.arrow_udf("struct<text: string, error: string>")
    def extracted(mimes: pa.Array, contents: pa.Array) -> pa.Array:
        rows = []
        for mime, content in zip(mimes.to_pylist(), contents.to_pylist(), strict=True):
            row = {"text": None, "error": None}
            if mime in extractors and content is not None:
                try:
                    row["text"] = extractors[mime](bytes(content))
                except Exception as e:  # noqa: BLE001  an extractor's failure is a row's error, not the job's
                    row["error"] = f"{type(e).__name__}: {e}"
            rows.append(row)
        return pa.array(rows, kind)

    return extracted


def _html(content: bytes) -> str:
    return page_text(content.decode("utf-8", "replace"))


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """``files(mime_type, content, error, ...)`` with ``text`` and ``error``.

    Plain text passes through, Markdown is a chain of expressions; HTML and the given ``extractors`` (by MIME type, which
    may replace any of them) run in a helper. A type nobody knows is an error.
    """
    mine = {"text/html": _html, **(extractors or {})}
    plain = X.plain_text(F.col("content"))
    helped = F.col("mime_type").isin(list(mine)) & F.col("error").isNull()
    rows = files.withColumn("_h", _helper_text(mine)(F.when(helped, F.col("mime_type")), F.when(helped, F.col("content"))))
    text = F.when(helped, F.when(F.col("mime_type") == "text/html", X.strip(F.col("_h.text"))).otherwise(F.col("_h.text")))
    text = text.when(F.col("mime_type") == "text/markdown", X.markdown_text(plain)).when(F.col("mime_type") == "text/plain", plain)
    unknown = F.when(text.isNull() & F.col("_h.error").isNull(), F.concat(F.lit("no extractor for "), F.col("mime_type")))
    error = F.coalesce(F.col("error"), F.col("_h.error"), unknown)
    return rows.select(*[c for c in files.columns if c not in ("error", "text")], F.when(error.isNull(), text).alias("text"), error.alias("error"))


def raw_rows(files: DataFrame) -> DataFrame:
    """Rows ``sha256, ext, content`` of the archive of sources; ``row`` and without contents if the files are."""
    return files.select("sha256", F.lower(X.extension(F.col("path"))).alias("ext"), *[c for c in ("content", "row") if c in files.columns])
