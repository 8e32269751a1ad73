"""Embedding codecs and similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bytes(vector: Column) -> Column:
    """``array<float>`` as little-endian float32 bytes; null stays null."""

    @F.arrow_udf("binary")
    def packed(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else np.asarray(r, "<f4").tobytes() for r in rows.to_pylist()], pa.binary())

    return packed(vector)


def from_bytes(data: Column) -> Column:
    """The reverse; bytes that are no whole number of floats give null."""

    @F.arrow_udf("array<float>")
    def unpacked(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None or len(r) % 4 else np.frombuffer(r, "<f4") for r in rows.to_pylist()], pa.list_(pa.float32()))

    return unpacked(data)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 where lengths differ, a vector is empty or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))
