import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from folio.llm.pii import base_candidates, train
from folio.llm.quality import text_stats
from folio.llm.quality import train as train_quality

from .test_line_dedup import WORD
from .test_line_dedup import brute as brute_lines
from .test_near_copies import brute_kept


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, small)
        if k < len(P.STAGES) - 1:
            assert out.columns == P.COLUMNS, name
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            sizes.append(docs.count())
        else:
            packed = out.collect()
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 100
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not any(c[3] for r in docs.collect() for c in base_candidates(r["text"]))
    assert docs.where("n_chars != char_length(text)").count() == 0


def test_chain_against_brute_force(spark, small, small_docs):
    """Every stage's result, text by text, on what the stage before kept; the last one's pieces by the tokenizer's own library."""
    frame = spark.read.parquet(f"{small}/documents.parquet")
    texts, model = dict(small_docs), train_quality(frame, spark.read.parquet(f"{small}/labels.parquet"))
    stats = {d: text_stats(t) for d, t in texts.items()}
    good = lambda s: not (s[0] < 50 or 100 * s[4] > 50 * s[0]) and bool(model.good(np.array([s], "int64"))[1][0])
    texts = {d: t for d, t in texts.items() if good(stats[d])}
    lines = {d: "\n".join(x) for d, x in brute_lines(texts).items()}
    texts = {d: t for d, t in lines.items() if t == texts[d] or WORD.search(t)}
    kept = brute_kept(texts)
    texts = {d: t for d, t in texts.items() if d in kept}
    pii = train(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for d, text in texts.items():
        for k, a, b in sorted(pii.spans(text), key=lambda s: -s[1]):
            texts[d] = text = text[:a] + f"<{k}>" + text[b:]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    wanted = {}
    for d, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            wanted[d, k] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    rows = P.run(spark, small).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == wanted and len(rows) == len(wanted)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for of in places.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(w[1] for w in wanted.values()) // 2048) + 1


def test_empty(spark, folder):
    assert P.run(spark, folder()).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and other columns through every stage."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "x"
    text = lambda a, n: " ".join(word(a + 7 * i) for i in range(n))
    rows = [(1, None), (2, ""), (3, " \n "), (4, text(0, 90)), (4, text(0, 90)), (5, text(0, 90)), (None, text(3_000, 80)), (None, text(5_000, 80)), (6, text(9_000, 60) + " mail a.b@c.org"), (7, "\n".join(text(20_000 + 280 * i, 40) for i in range(300))), (8, text(12_000, 30))]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _text string, k1 int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == P.COLUMNS, name
        kept.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
    texts = {r["doc_id"]: r["text"] for r in kept.where("doc_id is not null").collect()}
    assert set(texts) == {4, 6, 7} and texts[4] == text(0, 90) and texts[6].endswith("mail <email>") and texts[7] == rows[9][1]
    assert kept.where("doc_id is null").count() == 2 and kept.count() == 5
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {None, 4, 6, 7} and sum(r["piece"] == 0 for r in pieces) == 5
    assert sum(r["length"] for r in pieces if r["doc_id"] == 7) > 2048
