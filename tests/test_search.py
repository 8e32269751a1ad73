import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from folio.operators import hybrid, keyword, lookup, metadata, ranking, scan, vector
from folio.operators.ranking import effective_k

CHUNKS = [
    (1, 1, 0, "authentication JWT token RS256 security", [1.0, 0.0, 0.0]),
    (2, 1, 7, "JWT configuration setting", None),
    (3, 2, 3, "unrelated text about cars", [1.0, 0.0, 0.0]),
    (4, 2, 9, "café foo-bar bar foo", [0.8, 0.6, 0.0]),
]
SCHEMA = "chunk_id long, document_id long, chunk_index int, text string, embedding array<float>"


@pytest.fixture(scope="module")
def kb(spark):
    chunks = spark.createDataFrame(CHUNKS, SCHEMA).cache()
    docs = spark.createDataFrame([(1, "/a.md", "A"), (2, "/b.md", "B")], "document_id long, path string, title string")
    marks = spark.createDataFrame([(1, "lang", "go"), (1, "topic", "auth"), (2, "lang", "go")] + [(1, f"k{i}", "v") for i in range(12)], "document_id long, key string, value string")
    return chunks, docs, marks, keyword.build_index(chunks).cache()


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")


def found(rows, *columns):
    return [tuple(r[c] for c in columns) for r in rows.orderBy("query_id", "rank").collect()]


def test_keyword(spark, kb):
    chunks, docs, marks, index = kb
    queries = asked(spark, "JWT", "JWT!", "foo AND (", '"unterminated', "NOT OR", "", "CAFE", "foo-bar", "bar-foo", "jwt cars", "( !")
    rows = found(keyword.keyword_search(index, chunks, docs, queries), "query_id", "chunk_id", "source")
    assert [r[:2] for r in rows] == [(0, 2), (0, 1), (1, 2), (1, 1), (6, 4), (7, 4), (8, 4)]
    assert {r[2] for r in rows} == {"keyword"}
    scores = [r[0] for r in found(keyword.keyword_search(index, chunks, docs, asked(spark, "jwt")), "score")]
    assert scores == sorted(scores, reverse=True) and min(scores) > 0
    only = keyword.keyword_search(index, chunks, docs, asked(spark, "unrelated"), 5, marks, {"topic": "auth"})
    assert found(only, "chunk_id") == []
    twice = found(keyword.keyword_search(index, chunks, docs, asked(spark, "cars", "cars cars")), "score")
    assert twice[1][0] == pytest.approx(2 * twice[0][0])


def test_index(spark, kb):
    _, _, _, index = kb
    assert {(r["df"], r["cf"]) for r in keyword.term_statistics(index).where("term = 'foo'").collect()} == {(1, 2)}
    assert tuple(keyword.corpus_statistics(index).first()) == (4, 17)
    empty = keyword.build_index(spark.createDataFrame([(1, 1, "( )"), (2, 1, None)], "chunk_id long, document_id long, text string"))
    assert tuple(keyword.corpus_statistics(empty).first()) == (2, 0)
    assert keyword.keyword_ranks(empty, asked(spark, "x"), 5).count() == 0


def test_stored_index(spark, kb, tmp_path, monkeypatch):
    """A written index gives what one that is not written gives, whether its queries are broadcast and its terms pushed down or not."""
    chunks, docs, _, index = kb
    keyword.write_index(keyword.build_index(chunks), f"{tmp_path}/index", 4)
    written = keyword.read_index(spark, f"{tmp_path}/index")
    assert (written.buckets, written.chunks, written.words) == (4, 4, 17)
    queries = asked(spark, "JWT", "foo-bar", "text cars", "no such", "", "café bar")
    expected = found(keyword.keyword_ranks(index, queries, 5), "query_id", "chunk_id", "score")
    assert found(keyword.keyword_ranks(written, queries, 5), "query_id", "chunk_id", "score") == expected and len(expected) == 5
    monkeypatch.setattr(keyword, "MOST_TERMS", 1)
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 0)
    assert found(keyword.keyword_ranks(written, queries, 5), "query_id", "chunk_id", "score") == expected
    plan = keyword.keyword_ranks(written, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 0


def test_vector_blocks(spark, kb, monkeypatch):
    """Queries in several blocks, chunks in several batches, and ties give what one block gives; null vectors find nothing."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float).tolist()  # many ties
    chunks = spark.createDataFrame([(i, i, v) for i, v in enumerate(vectors)], "chunk_id long, document_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:25])] + [(99, None)], "query_id long, vec array<float>")
    whole = found(vector.vector_ranks(chunks, queries, 7), "query_id", "rank", "chunk_id")
    scores = vector.cosines(np.array(vectors, "float32"), np.array(vectors[:25], "float32"))
    for q in range(25):
        order = sorted((-scores[c, q], c) for c in range(300) if scores[c, q] >= 0)[:7]
        assert [c for i, _, c in whole if i == q] == [c for _, c in order]
    monkeypatch.setattr(vector, "QUERY_BLOCK", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        assert found(vector.vector_ranks(chunks, queries, 7), "query_id", "rank", "chunk_id") == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert vector.vector_ranks(chunks, queries.where("vec IS NULL"), 7).count() == 0


def test_vector(spark, kb):
    chunks, docs, marks, _ = kb
    one = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, vec array<float>")
    assert [(c, round(s, 6), p) for c, s, p in found(vector.vector_search(chunks, docs, one), "chunk_id", "score", "path")] == [(1, 1.0, "/a.md"), (3, 1.0, "/b.md"), (4, 0.8, "/b.md")]
    assert found(vector.vector_search(chunks, docs, one, 5, 0.9, marks, {"lang": "go", "topic": "auth"}), "chunk_id") == [(1,)]
    assert found(vector.vector_search(chunks, docs, one, 0, 0.0, marks, {f"k{i}": "v" for i in range(12)}), "chunk_id") == [(1,)]
    assert found(vector.vector_search(chunks.where("false"), docs, one), "chunk_id") == []
    zero = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0])], "query_id long, vec array<float>")
    assert found(vector.vector_search(chunks, docs, zero, 1), "query_id", "score") == [(0, 0.0)]
    with pytest.raises(vector.DimensionError):
        vector.vector_search(chunks, docs, spark.createDataFrame([(0, [1.0] * 4)], "query_id long, vec array<float>"))


def test_dimension(spark):
    rows = lambda *sizes: spark.createDataFrame([(i, [1.0] * n if n else None) for i, n in enumerate(sizes)], "document_id long, embedding array<float>")
    assert vector.check_dimension(rows(0)) is None and vector.check_dimension(rows(0, 3, 3)) == 3
    with pytest.raises(vector.DimensionError):
        vector.check_dimension(rows(3, 4))
    assert vector.check_dimension(rows(3, 4), without=spark.createDataFrame([(1,)], "document_id long")) == 3


def test_hybrid(spark, kb):
    chunks, docs, _, index = kb
    query = spark.createDataFrame([(0, "JWT authentication", [1.0, 0.0, 0.0])], "query_id long, text string, vec array<float>")
    rows = found(hybrid.hybrid_search(chunks, docs, index, query), "chunk_id", "score", "source")
    assert rows[0][0] == 1 and rows[0][1] == pytest.approx(2 / 61) and rows[0][2] == "hybrid"
    assert found(hybrid.hybrid_search(chunks, docs, index, query, 5, 0.02), "chunk_id") == [(1,)]
    assert hybrid.retrieve(chunks, docs, index, query, 1).first()["citation"] == "/a.md §0"
    assert (effective_k(0, None), effective_k(0, 7), effective_k(3, 7), effective_k(-1)) == (5, 7, 3, 5)


def test_metadata(spark, kb):
    chunks, docs, marks, _ = kb
    ids = lambda f, limit=20: [r["chunk_id"] for r in metadata.metadata_search(chunks, docs, marks, f, limit).collect()]
    assert ids({"lang": "go"}) == [1, 2, 3, 4] and ids({"lang": "go"}, 3) == [1, 2, 3]
    assert ids({"lang": "go", "topic": "auth"}) == [1, 2] and ids({}) == [] == ids({"lang": "java"})
    layer = spark.createDataFrame([(1, "lang", "rust"), (3, "x", "y")], marks.schema)
    assert {(r["document_id"], r["key"]): r["value"] for r in metadata.upsert(marks, layer).collect()} | {} == {**{(r["document_id"], r["key"]): r["value"] for r in marks.collect()}, (1, "lang"): "rust", (3, "x"): "y"}
    assert [r["key"] for r in metadata.entries(marks, 2).collect()] == ["lang"] and metadata.without(marks, 2, "lang").where("document_id = 2").count() == 0
    assert metadata.value_of(marks, 1, "topic").first()["value"] == "auth"
    auto = metadata.automatic(spark.createDataFrame([(1, "/d/README.MD")], "document_id long, path string"))
    assert {(r["key"], r["value"]) for r in auto.collect()} == {("filename", "README.MD"), ("extension", "md"), ("mime", "text/markdown"), ("dir", "/d")}


def test_lookup(spark, kb):
    chunks = kb[0]
    docs = spark.createDataFrame([(2, "/b.md", "x"), (1, "/a.md", "x"), (3, "/c.md", "y")], "document_id long, path string, sha256 string")
    assert lookup.document_by_path(docs, "/b.md").first()["document_id"] == 2 and lookup.document_by_path(docs, "/z").count() == 0
    assert lookup.document_by_hash(docs, "x").first()["document_id"] == 1
    assert {(r["sha256"], r["document_id"]) for r in lookup.first_by_hash(docs).collect()} == {("x", 1), ("y", 3)}
    assert [r["chunk_index"] for r in lookup.chunks_of(chunks, 1).collect()] == [0, 7]
    assert {tuple(r) for r in lookup.chunk_counts(docs, chunks).collect()} == {(1, 2), (2, 2), (3, 0)}


def test_embedding_errors(spark, kb):
    chunks = kb[0].select("chunk_id", "text")
    good = vector.embed_chunks(chunks, vector.hashed_embedder(8)).collect()
    assert all(len(r["embedding"]) == 8 and r["error"] is None for r in good)
    short = vector.embed_chunks(chunks, lambda texts: [[1.0]] * (len(texts) - 1)).collect()
    assert all(r["embedding"] is None and "vectors" in r["error"] for r in short)


def test_pruned_vector_search_is_exact_and_skips_clusters(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, i // 2, (centres[i % 12] + rng.normal(0, 0.1, 16)).tolist()) for i in range(600)]
    rows += [(1000 + i, i, rows[i][2]) for i in range(20)] + [(2000, 1, [0.0] * 16), (2001, 1, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, rows[i * 7][2]) for i in range(30)] + [(50, (-centres[0]).tolist()), (51, [0.0] * 16), (52, None)], "query_id long, vec array<float>")
    vector.write_vectors(chunks, f"{tmp_path}/v", 12)
    stored = vector.read_vectors(spark, f"{tmp_path}/v")
    rows_of = lambda f: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 12)) for r in f.collect())
    for k, least in ((5, 0.0), (700, -1.0), (3, 0.9)):
        assert rows_of(vector.pruned_ranks(stored, queries, k, least)) == rows_of(vector.vector_ranks(chunks, queries, k, least))
    visited, real = [], vector._cluster_scores
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vector, "_cluster_scores", lambda v, visits, *a: visited.append(visits) or real(v, visits, *a))
        vector.pruned_ranks(stored, queries.where("query_id < 30"), 5).collect()
    assert sum(v.sum() for v in visited) < 30 * 13 * 0.4  # most clusters are skipped
    marks = spark.createDataFrame([(d, "k", "x") for d in range(0, 300, 3)], "document_id long, key string, value string")
    assert rows_of(vector.pruned_ranks(stored, queries, 5, 0.0, marks, {"k": "x"})) == rows_of(vector.vector_ranks(chunks, queries, 5, 0.0, marks, {"k": "x"}))
    vector.write_vectors(chunks.where("false"), f"{tmp_path}/none", 12)
    assert vector.pruned_ranks(vector.read_vectors(spark, f"{tmp_path}/none"), queries, 5).count() == 0


def test_scores_are_computed_in_bounded_blocks(spark, monkeypatch):
    sizes, real = [], vector.cosines
    monkeypatch.setattr(vector, "cosines", lambda rows, queries: sizes.append(len(rows)) or real(rows, queries))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000))], ["x"])
    assert [b.num_rows for b in vector._slices([batch])] == [1024] * 4 + [904]
    big = np.ones((1024, 8), "float32")
    tracemalloc.start()
    vector.cosines(big, np.ones((2048, 8), "float32"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 1024 * 2048 * 8 / 2 and sizes


def test_words_that_cancel_out_have_a_direction():
    embed = vector.hashed_embedder(64)
    rows = embed(["word3 word4", "word4 word3", " . "])
    assert np.allclose(np.linalg.norm(rows, axis=1), [1, 1, 0])
    assert (rows[0] == rows[1]).all()


def test_scanned_texts_give_what_their_index_gives(spark, kb, monkeypatch):
    rng, names = np.random.default_rng(3), [f"w{i}" for i in range(12)] + ["café", "x_y"]
    texts = [" ".join(rng.choice(names, rng.integers(0, 30))) for _ in range(150)]
    texts += [texts[5], "", "w1 w1 w1 w1", None]
    chunks = spark.createDataFrame([(i, i // 2, 0, t) for i, t in enumerate(texts)], "chunk_id long, document_id long, chunk_index int, text string").repartition(5)
    queries = asked(spark, "w1", "w1-w1", "w1-w1 w1-w1", "w2 w3-w4", "w1-w2-w3", "CAFE w1-w2 w1", "nobody w1", "w1 w1-nobody", "x-y w5", "", "!", *[" ".join(rng.choice(names, 2)) + "-w1" for _ in range(20)])
    marks = spark.createDataFrame([(i, "odd", "y") for i in range(1, 80, 2)], "document_id long, key string, value string")
    rows = lambda index, k, *more: found(keyword.keyword_ranks(index, queries, k, *more), "query_id", "rank", "chunk_id", "document_id", "score")
    index = keyword.stored(keyword.build_index(chunks))
    wanted = [rows(index, 1000), rows(index, 3, marks, {"odd": "y"})]
    assert len(wanted[0]) > 300
    assert [rows(keyword.Texts(chunks), 1000), rows(keyword.Texts(chunks), 3, marks, {"odd": "y"})] == wanted
    monkeypatch.setattr(scan, "QUERY_BLOCK", 20)
    assert rows(keyword.Texts(chunks), 4) == [r for r in wanted[0] if r[1] <= 4]
    assert keyword.keyword_ranks(keyword.Texts(chunks), asked(spark, "", "!"), 3).count() == 0


def test_rows_without_an_id_have_a_length_and_no_hits():
    trie, _ = scan._asked([(1, "a b-c")])
    batch = pa.RecordBatch.from_pylist([{"chunk_id": None, "document_id": 1, "text": "a b c"}, {"chunk_id": 2, "document_id": 2, "text": "b c a b c"}, {"chunk_id": 3, "document_id": None, "text": "a"}])
    ((chunk, _, lengths, hits, f),) = scan._walked(iter([batch]), trie)
    assert lengths.tolist() == [3, 5, 1] and sorted(zip((hits // trie.n).tolist(), (hits % trie.n).tolist(), f.tolist(), strict=True)) == [(1, 0, 1), (1, 1, 2)]
