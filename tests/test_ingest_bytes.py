"""What an ingest moves and writes, and that contents which stay where they are still meet their documents."""

import random

from pyspark.sql import functions as F

from folio.operators import keyword
from folio.operators.ingest import Options, ingest, remove
from folio.operators.marks import marked, marks, numbered_once
from folio.sources.store import Store

SCHEMA = "path string, length long, content binary"


def files_of(spark, texts):
    return spark.createDataFrame([(p, len(t.encode()), bytearray(t.encode())) for p, t in texts.items()], SCHEMA)


def moved(spark):
    """Bytes shuffled, spilled and written by all stages until now."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (stages.apply(i) for i in range(stages.size())))


def test_an_ingest_moves_no_text(spark, tmp_path):
    dice = random.Random(7)
    words = ["".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=dice.randint(3, 9))) for _ in range(3000)]
    texts = {f"/{i}.txt": " ".join(dice.choices(words, k=400)) for i in range(1500)}
    texts |= {f"/copy{i}.txt": texts[f"/{i}.txt"] for i in range(60)}
    size = sum(len(t) for t in texts.values())
    store = Store(spark, str(tmp_path / "kb"), 2)
    before = moved(spark)
    done = ingest(store, files_of(spark, texts), Options(size=1 << 20, overlap=0))
    # 2.6 times the texts; 17.3 times when contents and texts were shuffled to be joined
    assert moved(spark) - before < 5 * size
    assert {r["status"] for r in done.collect()} == {"ingested"}
    assert store.read("extracted").count() == store.read("raw").count() == 1500 and store.read("chunks").count() == 1560


def test_copies_failures_and_known_texts_meet_their_documents(spark, tmp_path):
    called = tmp_path / "called"
    called.mkdir()

    def read(content):
        (called / f"{random.random()}").write_bytes(content)
        if content == b"bad":
            raise KeyError("bad")
        return content.decode().upper()

    def embed(texts):
        if any("POISON" in t for t in texts):
            raise ValueError("down")
        return [[1.0, 2.0]] * len(texts)

    options = Options(batch=1, embed=embed, extractors={"application/pdf": read})
    texts = {f"/{i}.pdf": f"text {i % 5}" for i in range(20)} | {"/x.pdf": "bad", "/y.pdf": "bad", "/p.pdf": "poison", "/q.pdf": "poison", "/e.pdf": "", "/t.txt": "text 1"}
    store = Store(spark, str(tmp_path / "kb"), 2)
    first = {r["path"]: (r["status"], r["chunks"]) for r in ingest(store, files_of(spark, texts).repartition(5), options).collect()}
    bad = {"/x.pdf", "/y.pdf", "/p.pdf", "/q.pdf"}
    assert first == {p: ("error", 0) if p in bad else ("ingested", 0 if p == "/e.pdf" else 1) for p in texts}
    assert len(list(called.iterdir())) == 8  # five texts, the empty one, and two that fail, each once
    found = lambda: {r["path"]: r["text"] for r in store.read("chunks").join(store.read("documents"), "document_id").collect()}
    assert found() == {p: t if p == "/t.txt" else t.upper() for p, t in texts.items() if t and p not in bad}
    # the texts of those that failed to be embedded are kept; no other is read again, and removed ones come back from the store
    remove(store, spark.createDataFrame([("/3.pdf",), ("/8.pdf",)], "path string"))
    assert store.read("documents").count() == 20 and store.read("chunks").count() == 19
    again = {r["path"]: r["status"] for r in ingest(store, files_of(spark, texts), options).collect()}
    assert again == {p: "error" if p in bad else "ingested" if p in ("/3.pdf", "/8.pdf") else "skipped" for p in texts}
    assert len(list(called.iterdir())) == 9
    assert found() == {p: t if p == "/t.txt" else t.upper() for p, t in texts.items() if t and p not in bad}
    n = store.numbers()
    assert (n["documents"], n["chunks"], n["indexed_chunks"]) == (22, 21, 21)


def test_a_file_without_content_is_a_document_without_chunks(spark, tmp_path):
    files = spark.createDataFrame([("/a.txt", 1, bytearray(b"a")), ("/b.txt", None, None), ("/c.txt", None, None)], SCHEMA)
    store = Store(spark, str(tmp_path / "kb"), 2)
    assert {r["path"]: (r["status"], r["chunks"]) for r in ingest(store, files).collect()} == {"/a.txt": ("ingested", 1), "/b.txt": ("ingested", 0), "/c.txt": ("ingested", 0)}
    assert store.read("documents").count() == 3 and store.read("raw").count() == store.read("extracted").count() == 1


def test_blocks_hold_all_postings(spark):
    texts = ["b a b  ünï a", "", None, "a", "word " * 300 + "x", "\U0001f600 日本語 a-b_c"]
    rows = [(i, i * 3 if i else None, t) for i, t in enumerate(texts * 40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string").repartition(3)
    read = lambda rows: sorted(((r["term"], r["chunk_id"], r["document_id"], r["positions"], r["dl"]) for r in rows.collect()), key=str)
    for buckets in (1, 7):
        dealt = keyword.dealt_index(chunks, buckets)
        assert read(dealt) == read(keyword.build_index(chunks))
    assert keyword.dealt_index(chunks.where("false"), 3).count() == 0
    # dealt by the bucket that Spark computes
    words = [t for (t,) in keyword.build_index(chunks).select("term").distinct().collect()] + ["x" * n for n in range(70)]
    spark_buckets = {r["t"]: r["b"] for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", keyword.bucket_of(F.col("t"), 64).alias("b")).collect()}
    assert spark_buckets == {w: keyword._bucket(w, 64) for w in words}


def test_marks(spark, tmp_path):
    numbers = spark.range(0, 100_000, 1, 3).select("id", numbered_once())
    numbers.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    some = marks(rows.where("id % 7 = 3"))
    inside, outside = marked(rows, some, some.count()), marked(rows, some, 1 << 40, inside=False)
    assert sorted(r["id"] for r in inside.collect()) == list(range(3, 100_000, 7))
    assert outside.where("id % 7 = 3").count() == 0 and outside.count() == 100_000 - 14_286
