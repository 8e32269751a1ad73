import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm.packing import WordIds, best_two_fit, op7_best_fit_packing, pack, pack_documents, token_pieces

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
MINE, THEIRS = WordIds(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abTh .,'\n\té́漢1²ßÀΣİ-", max_size=30))
def test_ids(text):
    assert np.frombuffer(MINE.text(text), "<u4").tolist() == THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "see", "here.", " ", "\n", "É", ",", "endoftext"]), max_size=8))
def test_added_tokens(parts):
    text = "".join(parts)
    assert np.frombuffer(MINE.text(text), "<u4").tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_repeated_rows_are_spread(spark):
    """Rows equal in everything, and rows of one id, do not end in one group."""
    rows = [(1, "same text", 0)] * 400 + [(None, f"text {i}", 0) for i in range(400)]
    pieces = token_pieces(spark.createDataFrame(rows, "doc_id long, text string, copy int").repartition(4))
    found = pack(pieces, 8).withColumn("group", F.shiftright("sequence_id", 32))
    sizes = {tuple(r)[:2]: r["count"] for r in found.groupBy("doc_id", "group").count().collect()}
    assert len(sizes) == 16 and max(sizes.values()) < 100 and sum(sizes.values()) == 800
    assert "copy" not in found.columns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins(lengths):
    bins, offsets = best_two_fit(np.array(lengths, "int64"), 50)
    inside = defaultdict(list)
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths):
        inside[b].append((o, n))
    for pieces in inside.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 50
    assert len(inside) <= max(1, 2 * -(-sum(lengths) // 50))


def test_nearly_full():
    lengths = np.random.default_rng(2).integers(1, 1500, 3000)
    assert best_two_fit(lengths)[0].max() + 1 <= -(-lengths.sum() // 2048) * 1.005 + 1


def test_query(spark, small, small_docs):
    rows = op7_best_fit_packing(spark, small).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in small_docs.items():
        ids = THEIRS.encode(text, add_special_tokens=False).ids + [0]
        expected = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        for k, part in enumerate(expected):
            r = pieces[d].pop(k)
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
        assert not pieces[d]
    for inside in sequences.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 2048) + 1


def test_odd_rows(spark, folder):
    rows = op7_best_fit_packing(spark, folder(ODD)).collect()
    assert sorted(r["length"] for r in rows)[:3] == [1, 1, 1] and sum(r["piece"] == 0 for r in rows) == len(ODD)
    assert op7_best_fit_packing(spark, folder()).count() == 0
    with_ids = token_pieces(spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, ids int"), with_ids=True).first()
    assert with_ids["ids"] == [*THEIRS.encode("a b", add_special_tokens=False).ids, 0]


def test_other_columns_do_not_matter(spark):
    rows = [(i, f"some text number {i}") for i in range(20)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    odd = plain.select("*", *[F.lit("x").alias(c) for c in ("piece", "length", "copy", "ids_crc32", "sequence_id", "offset", "group", "_group", "start")])
    key = lambda f: sorted(map(tuple, f.select("doc_id", "piece", "start", "length", "ids_crc32", "offset").collect()))
    assert key(pack_documents(odd)) == key(pack_documents(plain))
