from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from folio.operators import changes, keyword, snapshot
from folio.operators.ingest import Options, ingest, remove, summary, update
from folio.sources import files as sources
from folio.sources import log
from folio.sources.log import Folder
from folio.sources.store import Store
from folio.streaming import incremental
from folio.streaming.incremental import ingest_stream


def put(folder, **names):
    folder.mkdir(exist_ok=True)
    for name, text in names.items():
        (folder / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())


def status(rows):
    return {r["path"].rsplit("/", 1)[1]: (r["status"], r["chunks"]) for r in rows.collect()}


def test_ingest(spark, tmp_path):
    src = tmp_path / "src"
    put(src, a__md="# Title\n\nThe quick brown fox.\n", b__TXT="plain text", c__html="<p>Hi &amp; ho</p>", d__pdf=b"%PDF", e__markdown="no", g__txt=" \n")
    store = Store(spark, str(tmp_path / "kb"))
    read = lambda: sources.read_files(spark, str(src))
    first = status(ingest(store, read()))
    assert first == {"a.md": ("ingested", 1), "b.TXT": ("ingested", 1), "c.html": ("ingested", 1), "d.pdf": ("error", 0), "g.txt": ("ingested", 0)}
    texts = {r["text"] for r in store.read("chunks").collect()}
    assert texts == {"Title\n\nThe quick brown fox.", "plain text", "Hi & ho"}
    assert store.read("documents").count() == 4 and store.read("raw").count() == 5
    again = status(ingest(store, read()))
    assert again["a.md"] == ("skipped", 0) and again["d.pdf"] == ("error", 0)
    assert store.read("chunks").count() == 3 and store.read("raw").count() == 5
    put(src, a__md="# Title\n\nChanged.\n")
    third = status(ingest(store, read(), Options(extractors={"application/pdf": lambda b: b.decode()})))
    assert third["a.md"] == ("ingested", 1) and third["d.pdf"] == ("ingested", 1) and third["b.TXT"] == ("skipped", 0)
    assert "Title\n\nChanged." in {r["text"] for r in store.read("chunks").collect()}
    assert {r["key"] for r in store.read("metadata").collect()} == {"filename", "extension", "mime", "dir"}
    assert store.read("postings").where("term = 'quick'").count() == 0 and store.read("postings").where("term = 'changed'").count() == 1

    def broken(texts):
        raise RuntimeError("down")

    before = {r["chunk_id"] for r in store.read("chunks").collect()}
    failed = ingest(store, read(), Options(force=True, embed=broken))
    assert {r["status"] for r in failed.where("chunks = 0 AND error IS NOT NULL").collect()} == {"error"}
    assert {r["chunk_id"] for r in store.read("chunks").collect()} == before
    assert {r["status"]: r["n"] for r in summary(failed).collect()} == {"error": 4, "ingested": 1}


def test_too_large_and_crash(spark):
    rows = spark.createDataFrame([("/x.txt", 100 << 20, bytearray(b"x")), ("/y.txt", (100 << 20) + 1, bytearray(b"y")), ("/z.pdf", 1, bytearray(b"z"))], "path string, length long, content binary")

    def crash(content):
        raise KeyError("bad")

    got = {r["path"]: (r["text"], r["error"]) for r in sources.extract(sources.described(rows), {"application/pdf": crash}).collect()}
    assert got["/x.txt"] == ("x", None) and "more than" in got["/y.txt"][1] and "KeyError" in got["/z.pdf"][1]


def test_stream(spark, tmp_path):
    src, store = tmp_path / "src", Store(spark, str(tmp_path / "kb"))
    put(src, a__md="one", b__md="two")
    run = lambda: ingest_stream(store, str(src), str(tmp_path / "check")).awaitTermination(120)
    run()
    assert store.read("documents").count() == 2
    put(src, c__md="three")
    run()
    assert store.read("documents").count() == 3 and store.read("chunks").count() == 3


def test_delete_and_snapshot(spark, tmp_path):
    src, store = tmp_path / "src", Store(spark, str(tmp_path / "kb"))
    put(src, a__md="same", b__md="same", c__md="other")
    ingest(store, sources.read_files(spark, str(src)))
    state = store.read_all()
    path = str(tmp_path / "snap")
    snapshot.export_snapshot(state, path)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.export_snapshot(state, path)
    gone = state["documents"].where(F.col("path").endswith("/a.md") | F.col("path").endswith("/c.md")).select("path")
    left, report = changes.delete_documents(state, gone.unionByName(spark.createDataFrame([("/none",)], "path string")))
    assert sorted((r["status"], r["chunks"]) for r in report.collect()) == [("deleted", 1), ("deleted", 1), ("not found", 0)]
    assert left["chunks"].count() == 1 and left["extracted"].count() == 1 and left["raw"].count() == 2
    back, done = snapshot.restore_snapshot(path, left)
    counts = {(r["name"], r["status"]): r["n"] for r in done.collect()}
    assert counts["documents", "written"] == 2 and counts["documents", "skipped"] == 1 and back["chunks"].count() == 3
    forced, _ = snapshot.restore_snapshot(path, left, force=True)
    assert forced["documents"].count() == 3
    with pytest.raises(snapshot.SnapshotError):
        snapshot.open_snapshot(spark, str(tmp_path / "nothing"))
    # a forced export that fails leaves the snapshot that is there whole
    bad = {**state, "metadata": state["metadata"].withColumn("value", F.when(F.rand() < 2, F.raise_error(F.lit("lost")).cast("string")))}
    with pytest.raises(Exception, match="lost"):
        snapshot.export_snapshot(bad, path, force=True)
    assert snapshot.open_snapshot(spark, path)["documents"].count() == 3
    snapshot.export_snapshot({k: left[k] for k in ("documents", "chunks")}, path, force=True)
    assert snapshot.open_snapshot(spark, path)["documents"].count() == 1


def test_a_second_snapshot_copies_only_what_changed(spark, tmp_path):
    schema = snapshot.TABLES["metadata"]
    rows = [(i, "key", f"value {i}") for i in range(300)]
    path, table = str(tmp_path / "snap"), lambda r: {"metadata": spark.createDataFrame(r, schema), "raw": spark.createDataFrame([], snapshot.TABLES["raw"])}
    first = {r["part"]: r for r in snapshot.export_snapshot(table(rows), path).collect() if r["name"] == "metadata"}
    changed = [(7, "key", "other"), *[r for r in rows if r[0] not in (7, 9)]]
    second = {r["part"]: r for r in snapshot.export_snapshot(table(changed), path, force=True).collect() if r["name"] == "metadata"}
    moved = {p for p in second if second[p]["place"] != first[p]["place"]}
    assert 1 <= len(moved) <= 2 and {p for p in second if second[p]["hash"] != first[p]["hash"]} == moved
    files = lambda v: sorted(f.parent.name for f in (tmp_path / "snap" / v / "metadata").glob("part=*/*.parquet"))
    assert set(files("v2")) == {f"part={p}" for p in moved} and len(set(files("v1"))) == len(first)
    opened = snapshot.open_snapshot(spark, path)
    assert sorted(map(tuple, opened["metadata"].collect())) == sorted(changed) and opened["raw"].count() == 0
    # two values of one part are exchanged: as many rows, the same values, all of them where they were
    part = next(r for r in second.values() if r["rows"] > 1)
    at = f"{path}/{part['place']}"
    a, b, *rest = spark.read.schema(schema).parquet(at).collect()
    swapped = [(a[0], a[1], b[2]), (b[0], b[1], a[2]), *map(tuple, rest)]
    spark.createDataFrame(swapped, schema).coalesce(1).write.mode("overwrite").parquet(at)
    with pytest.raises(snapshot.SnapshotError, match="differs"):
        snapshot.open_snapshot(spark, path)


def parts_of(state, name):
    return state["parts"].get(name, {})


def numbers_agree(store):
    n, state = store.numbers(), store.read_all()
    chunks = state["chunks"].agg(F.count("*"), F.sum(F.char_length("text")), F.count("embedding")).first()
    ones = state["postings"].where("term = ''").agg(F.count("*"), F.sum("dl")).first()
    assert (n["documents"], n["chunks"], n["chars"], n["embedded"], n["indexed_chunks"], n["words"]) == (state["documents"].count(), *[x or 0 for x in (*chunks, *ones)])


def searched(store, chunks, *texts):
    """Ranks by the index as it stands, and by one that is built anew."""
    queries = store.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    both = [keyword.keyword_ranks(index, queries, 20) for index in (store.index(), keyword.build_index(chunks))]
    got, expected = ([(r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in ranks.orderBy("query_id", "rank").collect()] for ranks in both)
    assert got == expected
    return got


def test_only_what_is_touched_is_read_and_written(spark, tmp_path):
    src, store = tmp_path / "src", Store(spark, str(tmp_path / "kb"), 8)
    put(src, **{f"f{i}__md": f"text number {i}" for i in range(30)})
    read = lambda: sources.read_files(spark, str(src))
    ingest(store, read())
    before = store.state()
    put(src, f7__md="other text")
    read_parts, real = [], Store._rows
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Store, "_rows", lambda self, name, parts: read_parts.extend((name, p["bucket"]) for p in parts) or real(self, name, parts))
        assert status(ingest(store, sources.read_files(spark, str(src / "f7.md"))))["f7.md"] == ("ingested", 1)
    after = store.state()
    for name in ("documents", "chunks", "metadata", "postings", "extracted", "raw"):
        new = {k: p for k, p in parts_of(after, name).items() if k not in parts_of(before, name)}
        assert parts_of(after, name).items() >= parts_of(before, name).items()
        # two words and the length are three postings
        assert sum(p["rows"] for p in new.values()) == {"metadata": 4, "postings": 3}.get(name, 1), name
        assert len({b for n, b in read_parts if n == name}) <= 1, (name, read_parts)
    assert not {"chunks", "postings"} & {n for n, _ in read_parts}
    assert sum(p["rows"] for p in parts_of(after, "gone").values()) == 1
    again = Store(spark, store.folder, 99)
    assert again.buckets == 8 and again.fact("dimension") == "64"
    version = store.number()
    assert {s for s, _ in status(ingest(store, read())).values()} == {"skipped"} and store.number() == version
    texts = lambda: sorted(r["text"] for r in store.read("chunks").collect())
    expected = sorted(["other text", *(f"text number {i}" for i in range(30) if i != 7)])
    assert texts() == expected and store.read("documents").count() == 30 and store.read("extracted").count() == 30
    numbers_agree(store)
    assert searched(store, store.read("chunks"), "number", "other", "number-7", "text number-9")
    store.compact()
    numbers_agree(store)
    assert texts() == expected and not parts_of(store.state(), "gone") and all(len({p["bucket"] for p in parts.values()}) == len(parts) for parts in store.state()["parts"].values())
    assert store.clean() > 0 and texts() == expected
    searched(store, store.read("chunks"), "number", "other")


def test_removal_writes_no_text(spark, tmp_path):
    src, store = tmp_path / "src", Store(spark, str(tmp_path / "kb"), 8)
    put(src, **{f"f{i}__md": f"text number {i % 9}" for i in range(12)}, p__pdf="paper")
    read = lambda: sources.read_files(spark, str(src))
    ingest(store, read(), Options(extractors={"application/pdf": lambda b: b.decode()}))
    before = store.state()
    gone = remove(store, spark.createDataFrame([(str(src / n),) for n in ("f1.md", "f4.md", "p.pdf")] + [("/none",)], "path string"))
    assert sorted((r["status"], r["chunks"]) for r in gone.collect()) == [("deleted", 1)] * 3 + [("not found", 0)]
    after = store.state()
    assert {n for n in after["parts"] if parts_of(after, n) != parts_of(before, n)} == {"gone"}
    # f10 has the text of f1, nobody has that of f4
    assert store.read("documents").count() == 10 and store.read("chunks").count() == 10 and store.read("extracted").count() == 8 and store.read("raw").count() == 10
    numbers_agree(store)
    assert not [r for r in searched(store, store.read("chunks"), "paper", "number-4")]
    # what comes back is found in the store, not extracted again
    def broken(content):
        raise KeyError("called")

    assert status(ingest(store, read(), Options(extractors={"application/pdf": broken})))["p.pdf"] == ("ingested", 1)
    assert store.read("extracted").count() == 10
    remove(store, spark.createDataFrame([(str(src / "p.pdf"),)], "path string"))
    store.compact()
    assert store.clean() > 0 and store.read("extracted").count() == 9 and status(ingest(store, read(), Options(extractors={"application/pdf": broken})))["p.pdf"] == ("error", 0)
    numbers_agree(store)


@pytest.mark.parametrize("buckets, attempts", [(1, 2), (64, 1)])
def test_two_writers(spark, tmp_path, buckets, attempts):
    """Another writer commits while the first is about to: what concerns the same buckets is done again, and nothing is lost."""
    store, other = Store(spark, str(tmp_path / "kb"), buckets), Store(spark, str(tmp_path / "kb"), buckets)
    put(tmp_path / "a", x__md="first of a")
    put(tmp_path / "b", y__md="first of b")
    ingest(store, sources.read_files(spark, str(tmp_path / "a")))
    put(tmp_path / "a", x__md="second of a")
    tried, real = [], store.commit

    def late(*args, **kinds):
        if not tried:
            assert status(ingest(other, sources.read_files(spark, str(tmp_path / "b"))))["y.md"] == ("ingested", 1)
        tried.append(1)
        return real(*args, **kinds)

    store.commit = late
    assert status(ingest(store, sources.read_files(spark, str(tmp_path / "a"))))["x.md"] == ("ingested", 1)
    assert len(tried) == attempts
    assert sorted(r["text"] for r in store.read("chunks").collect()) == ["first of b", "second of a"] and other.number() == 3
    numbers_agree(store)


def test_one_number_is_taken_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "log"))
    made = ThreadPoolExecutor(8).map(lambda k: folder.create("00.commit", f"writer {k}"), range(24))
    assert sum(made) == 1 and folder.text("00.commit").startswith("writer ") and folder.names() == ["00.commit"]


def test_many_ingests_are_merged_and_the_log_is_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "FOLD", 2)
    src, store = tmp_path / "src", Store(spark, str(tmp_path / "kb"), 1)
    for i in range(4):
        put(src, **{f"f{i % 3}__md": f"text number {i}"})
        ingest(store, sources.read_files(spark, str(src / f"f{i % 3}.md")))
    assert len(parts_of(store.state(), "chunks")) == 4 and store.merge(4) > 8 and len(parts_of(store.state(), "chunks")) == 1
    assert any(n.endswith(".state") for n in Folder(spark, f"{store.folder}/log").names())
    assert sorted(r["text"] for r in store.read("chunks").collect()) == [f"text number {i}" for i in range(1, 4)]
    numbers_agree(store)
    searched(store, store.read("chunks"), "text", "number-3", "0")


def test_update_of_one_file(spark, tmp_path):
    src, store = tmp_path / "src", Store(spark, str(tmp_path / "kb"))
    put(src, a__md="one")
    assert status(update(store, str(src / "a.md"))) == {"a.md": ("ingested", 1)} and status(update(store, str(src / "a.md"))) == {"a.md": ("skipped", 0)}
    with pytest.raises(ValueError, match="not one file"):
        update(store, str(src))


def test_a_batch_that_was_committed_is_not_replayed(spark, tmp_path, monkeypatch):
    src, store, check = tmp_path / "src", Store(spark, str(tmp_path / "kb")), tmp_path / "check"
    put(src, a__md="one", b__md="two")
    run = lambda: ingest_stream(store, str(src), str(check)).awaitTermination(120)
    run()
    state, called = store.state(), []
    # the stream dies after the commit of the store, before its own
    for name in ("0", ".0.crc"):
        (check / "commits" / name).unlink(missing_ok=True)
    monkeypatch.setattr(incremental, "ingest", lambda *a: called.append(a))
    run()
    assert not called and store.state() == state and (check / "commits" / "0").exists()
    monkeypatch.undo()
    put(src, c__md="three")
    run()
    assert store.read("documents").count() == 3


def test_one_content_as_two_types(spark, tmp_path):
    src, store = tmp_path / "src", Store(spark, str(tmp_path / "kb"))
    put(src, a__md="**bold** text", b__txt="**bold** text", c__pdf="**bold** text")
    rows = {r["path"].rsplit("/", 1)[1]: (r["status"], r["error"]) for r in ingest(store, sources.read_files(spark, str(src))).collect()}
    assert rows["a.md"] == rows["b.txt"] == ("ingested", None) and rows["c.pdf"][0] == "error"
    assert sorted(r["text"] for r in store.read("chunks").collect()) == ["**bold** text", "bold text"]


def test_changes(spark):
    docs = spark.createDataFrame([(1, "/a", "x"), (2, "/b", "y")], "document_id long, path string, sha256 string")
    files = spark.createDataFrame([("/a", "x"), ("/b", "z"), ("/c", "x")], "path string, sha256 string")
    assert {r["path"]: r["change"] for r in changes.classify(files, docs).collect()} == {"/a": "unchanged", "/b": "changed", "/c": "new"}
    assert {r["path"]: r["change"] for r in changes.classify(files, docs, True).collect()}["/a"] == "forced"
    assert changes.repeated_content(files).first()["n"] == 2


def test_python_workers_get_few_rows_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("folio.operators.ingest.BATCH_ROWS", 2)
    files = spark.createDataFrame([(f"/{i}.txt", 9, bytearray(b"text %d" % i)) for i in range(40)], "path string, length long, content binary").coalesce(1)

    def embed(texts):
        if len(texts) > 2:
            raise ValueError("a large batch")
        return [[1.0]] * len(texts)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    done = ingest(Store(spark, str(tmp_path / "kb"), 2), files, Options(embed=embed))
    assert {r["status"] for r in done.collect()} == {"ingested"}
    assert spark.conf.get(key) == before
