"""Sentence-aware chunks of a fixed size in tokens, with overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import BLANKS

SIZE, OVERLAP = 400, 50
#: Where a chunk prefers to end, and bytes a token.
SEPARATORS = (b". ", b"\n\n", b"! ", b"? ")
TOKEN_BYTES = 4
PIECES = "array<struct<chunk_index: int, text: string, token_count: int, start_byte: int, end_byte: int>>"
_PIECE = pa.list_(pa.struct([("chunk_index", pa.int32()), ("text", pa.string()), ("token_count", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32())]))


def validate(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and the overlap from 0 to below it")


def _code_point_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def spans(data: bytes, size: int, overlap: int) -> list[tuple[int, int]]:
    """Byte spans of the chunks of a text that is not blank."""
    if size <= 0:
        return [(0, len(data))]
    width, back, out, start = TOKEN_BYTES * size, TOKEN_BYTES * overlap, [], 0
    while start + width < len(data):
        limit = start + width
        ends = [found + len(s) for s in SEPARATORS if (found := data.rfind(s, start, limit)) >= 0]
        end = _code_point_start(data, max(ends, default=limit))
        if end <= start:  # one character is wider than the chunk
            end = limit
        out.append((start, end))
        again = _code_point_start(data, end - back)
        start = again if again > start else end
    out.append((start, len(data)))
    return out


def chunk(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of a string column; blank and null texts have none. Sizes are in tokens of four bytes."""

    @F.arrow_udf(PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            rows = []
            if text and text.strip(BLANKS):
                data = text.encode()
                for k, (a, b) in enumerate(spans(data, size, overlap)):
                    rows.append({"chunk_index": k, "text": data[a:b].decode("utf-8", "replace"), "token_count": (b - a) // TOKEN_BYTES, "start_byte": a, "end_byte": b})
            out.append(rows)
        return pa.array(out, _PIECE)

    return pieces(text)


def chunk_key(document_id: Column, chunk_index: Column) -> Column:
    """A chunk's id: a hash of its document and place, whatever range the documents' ids have."""
    return F.xxhash64(document_id, chunk_index)


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``docs(document_id, text)`` as chunk rows without embeddings. Narrow: no shuffle."""
    rows = docs.select("document_id", F.inline(chunk(F.col("text"), size, overlap)))
    return rows.select(chunk_key(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", "text", "token_count", "start_byte", "end_byte")
