import re

from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.line_dedup import RUN_WORDS, dedup_lines, op4_line_dedup

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def numbered(text):
    return [(i, x, len(WORD.findall(x))) for i, x in enumerate(text.split("\n")) if WORD.search(x)]


def check(docs, got):
    """Every run of RUN_WORDS words that stands earlier goes if its fingerprint's first place has it; what goes stands earlier, in a run of as many words; the first of each line stays."""
    lines = {d: numbered(t) for d, t in docs.items()}
    places = {}
    for d in sorted(docs):
        for k, (_, x, _) in enumerate(lines[d]):
            places.setdefault(x, []).append((d, k))
    for d, text in docs.items():
        orig, rest = text.split("\n"), got[d].split("\n")
        if got[d] == text:
            continue
        kept, j = set(), 0
        for i, x in enumerate(orig):
            if j < len(rest) and rest[j] == x and (len(orig) - i >= len(rest) - j):
                kept.add(i)
                j += 1
        gone = [k for k, (i, _, _) in enumerate(lines[d]) if i not in kept]
        for k in gone:
            earlier = [p for p in places[lines[d][k][1]] if p < (d, k)]
            assert earlier, (d, k)
            best = 0
            for c, q in earlier:
                a = b = 0
                while k - a > 0 and q - a > 0 and lines[d][k - a - 1][1] == lines[c][q - a - 1][1]:
                    a += 1
                while k + b + 1 < len(lines[d]) and q + b + 1 < len(lines[c]) and lines[d][k + b + 1][1] == lines[c][q + b + 1][1]:
                    b += 1
                best = max(best, sum(n for _, _, n in lines[d][k - a : k + b + 1]))
            assert best >= RUN_WORDS, (d, k, best)


def test_query(spark, small, small_docs):
    rows = op4_line_dedup(spark, small).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    check(small_docs, got)
    # complete: just what a search over all pairs of places finds goes, and nothing else
    rest = {d: "\n".join(x) for d, x in brute({d: t or "" for d, t in small_docs.items()}).items()}
    assert got == rest
    seen = set()
    for d in sorted(small_docs):  # a whole later copy goes
        if small_docs[d] in seen and len(WORD.findall(small_docs[d])) >= RUN_WORDS:
            assert got[d] == ""
        seen.add(small_docs[d])


def passage(tag, lines, words):
    return [" ".join(f"{tag}{i}w{j}" for j in range(words)) for i in range(lines)]


def test_planted_runs(spark):
    run, long_line, short = passage("p", 6, 12), passage("q", 1, 60), passage("s", 2, 10)
    docs = {
        1: "\n".join(passage("a", 3, 30) + run + passage("b", 2, 30)),
        2: "\n".join(passage("c", 1, 9) + ["", *run[:3], "", *run[3:], ""] + passage("d", 1, 40)),
        3: "\n".join(long_line + passage("e", 2, 20)),
        4: "\n".join(passage("f", 2, 20) + long_line + passage("g", 1, 5) + long_line),
        5: "\n".join(short + passage("h", 1, 70)),
        6: "\n".join(passage("i", 1, 70) + short),
        7: "\n".join(run[:2] + passage("k", 1, 60) + run[2:]),
    }
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame).collect()}
    assert got[1] == docs[1] and got[3] == docs[3] and got[5] == docs[5] and got[6] == docs[6] and got[7] == docs[7]
    assert got[2].split("\n") == [*passage("c", 1, 9), "", "", *passage("d", 1, 40)]
    assert got[4].split("\n") == [*passage("f", 2, 20), *passage("g", 1, 5)]
    check(docs, got)


def test_odd_rows(spark, folder):
    rows = op4_line_dedup(spark, folder(ODD)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((i or 0, t or "") for i, t in ODD)
    twice = passage("r", 1, 80)[0]
    frame = spark.createDataFrame([(1, twice, 5), (1, twice, 6), (None, twice, 7)], "doc_id long, text string, n_lines int")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in dedup_lines(frame).collect())
    assert got == [(0, twice), (1, ""), (1, "")]
    assert op4_line_dedup(spark, folder()).count() == 0


def test_runs_around_a_frequent_line(spark):
    """A run is found wherever its lines first stand alone; what goes is just what a search over all pairs of places finds."""
    docs, d = {}, 0
    for k, (a, x, b) in enumerate([(10, 40, 10), (5, 45, 10), (25, 24, 20), (1, 48, 1)] * 8):
        run = passage(f"a{k}", 1, a) + passage(f"x{k}", 1, x) + passage(f"b{k}", 1, b)
        docs[d] = "\n".join(passage(f"u{k}", 2, 30) + run[1:2] + passage(f"v{k}", 2, 30))
        docs[d + 1] = "\n".join(passage(f"m{k}", 2, 30) + run + passage(f"n{k}", 2, 30))
        docs[d + 2] = "\n".join(passage(f"o{k}", 2, 30) + run + passage(f"p{k}", 2, 30))
        docs[d + 3] = "\n".join(passage(f"q{k}", 2, 30) + run[:2] + passage(f"r{k}", 2, 30))  # 25 to 50 words of it
        d += 4
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame).collect()}
    assert got == {d: "\n".join(rest) for d, rest in brute(docs).items()}
    assert all(len(got[d].split("\n")) == (4 if d % 4 == 2 else len(docs[d].split("\n"))) for d in docs if d % 4 != 3)


def brute(docs):
    """The lines that stay: without the later of any two equal runs of RUN_WORDS words or more."""
    lines = {d: t.split("\n") for d, t in docs.items()}
    places, gone = {}, set()
    for d in sorted(docs):
        for k, x in enumerate(lines[d]):
            for c, q in places.setdefault(x, []):
                n = words = 0
                while k + n < len(lines[d]) and q + n < len(lines[c]) and lines[d][k + n] == lines[c][q + n]:
                    words += len(WORD.findall(lines[d][k + n]))
                    n += 1
                if words >= RUN_WORDS:
                    gone |= {(d, k + i) for i in range(n)}
            places[x].append((d, k))
    return {d: [x for k, x in enumerate(lines[d]) if (d, k) not in gone] for d in docs}


def test_complete_on_more_documents(spark):
    """On the next larger table every line of a repeated run of RUN_WORDS words goes."""
    path = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in op4_line_dedup(spark, path).collect()}
    rest = brute(docs)
    worded = lambda xs: [x for x in xs if WORD.search(x)]
    assert sum(len(worded(docs[d].split("\n"))) - len(worded(rest[d])) for d in docs) > 500
    assert {d: worded(t.split("\n")) for d, (_, t) in got.items()} == {d: worded(rest[d]) for d in docs}


def test_frequent_keys_and_long_texts(spark, monkeypatch):
    """Keys of many rows are dealt over tasks with the same result; a text of many lines is whole."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    run = passage("p", 6, 12)
    docs = {d: "\n".join(passage(f"a{d}", 2, 20) + run + passage(f"b{d}", 1, 30)) for d in range(60)}
    docs[60] = "\n".join(passage("long", 4_000, 6) + run + passage("z", 2_000, 3))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame).collect()}
    assert got == {d: "\n".join(x for x in t.split("\n") if d == 0 or x not in run) for d, t in docs.items()}


def test_equal_rows_and_clashing_columns(spark, monkeypatch):
    """A text that very many rows have is taken apart once, and every row of it gets the same result."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    rows = [(i, f"start {i}\n{passage}\nend {i}") for i in range(3)] + [(9, f"own line\n{passage}")] * 30 + [(None, f"{passage}\nlast")] * 20
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    odd = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["k0", "k1", "k2", "runs", "cut", "size", "own", "whole", "_text", "s", "p"])])
    got = dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_deleted"]
    found = got.collect()
    assert all([r[c] for c in odd.columns[2:]] == list(range(11)) for r in found) and len(found) == len(rows)
    monkeypatch.setattr(common, "HOT_ROWS", 1000)
    expected = dedup_lines(plain).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_lines"], r["n_deleted"])
    assert sorted(map(key, found)) == sorted(map(key, expected))
    # null ids come first: the passage stays there and goes everywhere else
    assert {r["n_deleted"] for r in found if r["doc_id"] is None} == {0} and {r["n_deleted"] for r in found if r["doc_id"] is not None} == {6}
