import random
import re
import zlib
from collections import Counter

import pytest

from folio.llm import spelling as S

from .conftest import ODD

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words):
    forms, out = {}, []
    links = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    for w, n in words.items():
        best = min(links[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w] or "", root, n, len(links[w]), words[forms[w]] if forms[w] else 0))
    return sorted(out)


def rows_of(frame):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in frame.collect())


def variants(seed, n):
    rng = random.Random(seed)
    letters = "aabcdeééÿz"
    base = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(n)]
    found = set(base)
    for w in base * 4:
        i, c = rng.randrange(len(w)), rng.choice(letters)
        found |= {w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]}
    return sorted(found)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_groups_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    words = {w: rng.choice((1, 2, 4, 8, 16, 3, 3)) for w in variants(partitions, 60)} | {"aaaaaa": 9, "aaaaa": 4, "aaaa": 2, "b": 1, "x" * 3000: 3, "x" * 2999 + "y": 7, "x" * 2999: 20}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = rows_of(S.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert got == brute_groups(words)


@pytest.mark.parametrize("partitions", [1, 5, 60])
def test_nodes_are_those_of_a_trie(spark, partitions):
    words = variants(7, 40) + ["q" * k for k in range(1, 40)] + ["r" * 500 + c for c in "abc"]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = S.numbered_nodes(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    number = {}
    for r in rows:
        assert len(r["nodes"]) == len(r["word"]) + 1
        for d, node in enumerate(r["nodes"]):
            assert number.setdefault(r["word"][:d], node) == node
    assert len(set(number.values())) == len(number)
    assert [r["word"] for r in sorted(rows, key=lambda r: r["id"])] == sorted(words)


def test_query_against_brute_force(spark, folder):
    rng = random.Random(5)
    words = [w for w in variants(9, 50)]
    docs = [(i, " ".join(rng.choices(words, k=60)) + " École-ÉCOLE écolé×÷ naïve's straße ŵelsh") for i in range(-3, 80)] + ODD
    docs += [(500, "Colour color " * 200_000), (501, "y" * 30_000 + " " + "y" * 30_000), (502, "y" * 30_000)] + [(503, "copied words counted twice")] * 3
    got = rows_of(S.op13_spelling(spark, folder(docs)))
    assert got == brute_groups(brute_words(docs)) and any(r[1] for r in got)
    assert S.op13_spelling(spark, folder()).count() == 0
    assert S.op13_spelling(spark, folder([(1, "few words")])).count() == 0


def test_whole_small_table(spark, small, small_docs):
    words = brute_words(small_docs.items())
    got = {r["word"]: r for r in S.op13_spelling(spark, small).collect()}
    assert {w: r["n"] for w, r in got.items()} == words
    for w in sorted(words)[::40]:
        links = [v for v in words if near(w, v)]
        assert got[w]["n_near"] == len(links)
