import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm.byte_bpe import ByteBpe, decode, encode, op1_byte_bpe

from .conftest import ODD

CODEC = ByteBpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abtheing'st .,\n\t0é漢😀́", max_size=40))
def test_like_the_library(text):
    ids = CODEC.encode(text).tolist()
    assert ids == THEIRS.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("pattern", [r"[\s\S]+", r"\S+ ?|\s+", r"[^,]+|,"])
def test_other_patterns(pattern):
    """A pattern that does not start a match at every blank: texts are not cut there."""
    codec = ByteBpe(CODEC.ranks, pattern)
    theirs = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=CODEC.ranks, special_tokens={})
    for text in ("the rain in spain, and so on.", "a b", " x  y. z,", "one.", "being there. again"):
        assert codec.encode(text).tolist() == theirs.encode_ordinary(text)


def test_long_piece():
    text = "ab" * 30_000
    assert CODEC.encode(text).tolist() == THEIRS.encode_ordinary(text)


def test_query(spark, small, small_docs):
    for row in op1_byte_bpe(spark, small).collect():
        ids = THEIRS.encode_ordinary(small_docs[row["doc_id"]])
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(small_docs[row["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, folder):
    rows = op1_byte_bpe(spark, folder(ODD)).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] == 1} == {0}
    assert op1_byte_bpe(spark, folder()).count() == 0
    extra = spark.createDataFrame([("a b", 1, 2)], "text string, ids int, data int")
    both = extra.withColumn("ids", encode("text")).withColumn("data", decode(F.col("ids"))).first()
    assert bytes(both["data"]) == b"a b"


def test_unknown_bytes_are_an_error():
    with pytest.raises(ValueError):
        ByteBpe({b"a": 0}, public_tokenizers.PATTERN).encode_piece(b"ab")
