from folio.operators import prompt
from folio.operators.report import as_json, as_lines, health, kb_stats, list_documents


def test_budget_and_prompts(spark):
    retrieved = spark.createDataFrame([(0, i, f"/n.md §{i}", c * 40) for i, c in enumerate("abc", 1)], "query_id long, rank int, citation string, text string")
    kept = prompt.within_budget(retrieved, 25)
    assert sorted(r["rank"] for r in kept.collect()) == [1, 2]
    assert prompt.within_budget(retrieved, 0).count() == 3 and prompt.within_budget(retrieved, 1).count() == 1
    queries = spark.createDataFrame([(0, "What {text}?"), (1, "Nothing")], "query_id long, text string")
    rows = {r["query_id"]: r for r in prompt.render_prompts(queries, kept, prompt.QA, require_context=True).collect()}
    assert rows[0]["user"] == "Question:\n\nWhat {text}?\n\nContext:\n\n\nSource: /n.md §1\n\n" + "a" * 40 + "\n\n\nSource: /n.md §2\n\n" + "b" * 40 + "\n\n"
    assert (rows[0]["status"], rows[1]["status"], rows[1]["n_chunks"]) == ("ready", "error", 0)
    template = prompt.Template("t", "{tone} {question}", "", "", "", variables={"tone": "dry", "x": "1"})
    assert prompt.render_prompts(queries, kept, template, {"tone": "warm"}).where("query_id = 1").first()["system"] == "warm Nothing"
    answers = prompt.answer(prompt.render_prompts(queries, kept, prompt.QA, require_context=True), lambda s, u: "Yes")
    got = {r["query_id"]: r["output"] for r in prompt.finished(answers, prompt.QA).collect()}
    assert got == {0: "Yes\n\nSources:\n  [1] /n.md §1\n  [2] /n.md §2\n", 1: None}


def test_reports(spark):
    docs = spark.createDataFrame([(1, "/a.md", "Alpha"), (2, "/b.md", "Beta")], "document_id long, path string, title string").selectExpr("*", "timestamp'2026-01-01 00:00:00' AS updated_at")
    chunks = spark.createDataFrame([(10, 1, "hello", [1.0]), (11, 1, "world", None)], "chunk_id long, document_id long, text string, embedding array<float>")
    assert tuple(kb_stats(docs, chunks).first()) == (2, 2, 1, 10)
    assert tuple(kb_stats(docs.where("false"), chunks.where("false")).first()) == (0, 0, 0, 0)
    assert [(r["path"], r["chunks"]) for r in list_documents(docs, chunks).collect()] == [("/a.md", 2), ("/b.md", 0)]
    assert list_documents(docs, chunks, 1).count() == 1
    assert as_json(list_documents(docs, chunks, 1), ["path", "chunks", "updated_at"]).first()["json"] == '{"path":"/a.md","chunks":2,"updated_at":"2026-01-01T00:00:00Z"}'
    from folio.operators.keyword import build_index

    marks = spark.createDataFrame([(9, "k", "v")], "document_id long, key string, value string")
    report = {r["check"]: (r["value"], r["ok"]) for r in health(docs, chunks, marks, build_index(chunks.where("chunk_id = 10")), 3).collect()}
    assert report["orphan_metadata"] == (1, False) and report["chunks_not_indexed"] == (1, False) and report["embedding_dimensions"] == (1, False)
    results = spark.createDataFrame([(0, 1, 0.5, "/a.md", 0, "x\x07" + "y" * 200)], "query_id long, rank int, score double, path string, chunk_index int, text string")
    assert as_lines(results).first()["line"] == "[1] score=0.5000  /a.md §0\n    x" + "y" * 119 + "..."
