import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm.boosting import fit
from folio.llm.quality import STATS, features, op2_quality, score_quality, text_stats, train

from .conftest import ODD


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x1c", max_size=60))
def test_stats(text):
    assert text_stats(text)[:5] == brute(text)


def test_monotone_trees():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(12 * x[:, 1]) + rng.normal(0, 0.2, 3000) > 0.5).astype(int)
    trees = fit(x, y, {0: 1, 1: -1})
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(rng.random((50, 3)), 40, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.score(grid).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8
    assert fit(x, np.ones(3000)) is None and fit(x[:0], y[:0]) is None


def test_query(spark, small, small_docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = op2_quality(spark, small).collect()
    for r in rows:
        words, *rest = brute(small_docs[r["doc_id"]])
        assert [r[s] for s in STATS[:5]] == [words, *rest]
        assert r["base_failed"] == (words < 50 or 100 * rest[-1] > 50 * words) and not (r["base_failed"] and r["kept"])
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(good) >= 0.97 * len(good)


def test_odd_rows(spark, folder):
    rows = op2_quality(spark, folder(ODD, [(4, 1, 0), (None, 0, 0), (99, None, 1)])).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows)
    assert op2_quality(spark, folder()).count() == 0


def test_clashing_columns_and_a_frequent_id(spark):
    """Columns named like results are replaced; an id of many rows does not swell the sample."""
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, f"{good} {i % 300}", 7, "x") for i in range(900)] + [(2, "#### " * 60 + good, 8, "y"), (2, "#### " * 60 + good, 8, "y"), (3, good, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    got = score_quality(docs, train(docs, labels, 50)).collect()
    assert len(got) == len(rows) and {type(r["kept"]) for r in got} == {bool} and {r["n_words"] for r in got if r["doc_id"] == 3} == {80}


def test_verdict_is_that_of_the_trees_one_by_one(spark, small, small_docs):
    """The flat arrays give what walking each tree from its root gives, and the verdict is its threshold."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = train(docs, labels)
    rows = {r["doc_id"]: r for r in score_quality(docs, model).collect()}
    for d, text in list(small_docs.items()):
        x, margin = features(np.array([text_stats(text)], "int64"))[0], model.trees.base
        for feature, split, leaf in zip(model.trees.feature, model.trees.split, model.trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (1 if x[feature[node]] <= split[node] else 2)
            margin += leaf[node - len(feature)]
        score = 1 / (1 + np.exp(-margin))
        assert abs(rows[d]["quality_score"] - score) < 1e-12
        assert rows[d]["kept"] == (not rows[d]["base_failed"] and rows[d]["quality_score"] >= model.threshold)
