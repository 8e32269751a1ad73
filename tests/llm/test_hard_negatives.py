import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor):
    """(anchor, positive, rank, negative, scores) over all pairs, in whole numbers."""
    fit = []
    for vec_id, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        fit.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    out = []
    best = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:5]
    for i, (a, label, v) in enumerate(fit):
        if a is None or not anchor(a):
            continue
        scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(map(int.__mul__, v, w)))), c, k, j) for j, (c, k, w) in enumerate(fit) if len(w) == len(v) and j != i]
        for p, positive, _, _ in best([s for s in scores if s[2] == label]):
            window = [s for s in scores if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(a, positive, r, n, p, score) for r, (score, n, _, _) in enumerate(best(window), 1)]
    return out


def key(row):
    return tuple(-(1 << 62) if x is None else x for x in row)


def found(frame):
    return sorted(map(tuple, frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=key)


def sample(n, dims=6, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0.05, 0.2, (n, dims)).astype("float32")
    vectors[n // 2 : n // 2 + n // 8] = np.round(vectors[n // 2 : n // 2 + n // 8] * 4) / 4  # many ties
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, rng.integers(0, labels, n), strict=True))]


@pytest.mark.parametrize("cell", [(1024, 4096), (7, 40)])
def test_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(H, "ANCHORS", cell[0])
    monkeypatch.setattr(H, "CANDIDATES", cell[1])
    rows = sample(260)
    rows += [(None, rows[3][1], 1), (10, rows[10][1], rows[10][2]), (10, rows[11][1], 2), (-20, rows[5][1], 0), (300, None, 1), (310, [0.1] * 6, None), (320, [0.1, None] * 3, 1), (330, [float("nan")] * 6, 1), (340, [float("-inf")] * 6, 1), (350, [], 1), (360, [], 2), (370, [0.5, 0.25], 1), (380, [0.5, 0.5], 1), (390, [0.5, 0.1], 2), (400, [0.0] * 6, 3), (410, [-0.001] * 6, 3)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = found(H.hard_negatives(frame, F.col("vec_id") % 10 == 0))
    assert got == sorted(brute(rows, lambda i: i % 10 == 0), key=key) and len(got) > 200


def test_query_relabels(spark, tmp_path):
    rows = sample(500, 8, 10, 4)
    spark.createDataFrame(rows, SCHEMA).withColumn("_extra", F.lit(1)).withColumn("row", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    expected = brute([(i, v, (k + 1) % 10 if i % 7 == 0 else k) for i, v, k in rows], lambda i: i % 100 == 0)
    assert found(H.op12_hard_negatives(spark, str(tmp_path))) == sorted(expected, key=key)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert H.op12_hard_negatives(spark, f"{tmp_path}/none").count() == 0


def test_large_components_and_one_vector_many_times(spark):
    rows = [(i, [3e8 * (i + 1), -2e8], i % 2) for i in range(30)] + [(100, [1.0, 1.0], 0)] * 50 + [(101, [1.0, 1.0], 1)] * 50
    frame = spark.createDataFrame(rows, SCHEMA)
    got = found(H.hard_negatives(frame, F.col("vec_id") % 10 == 0))
    assert got == sorted(brute(rows, lambda i: i % 10 == 0), key=key) and max(r[4] for r in got) == (1 << 63) - 1


def test_search_stops_early():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(0, 10, (2000, 4)))
    vectors[:5] = [[90, 90, 90, 90]] * 5
    lists, scored = H.Lists(vectors), []

    class Counted(np.ndarray):
        def __getitem__(self, which):
            scored.append(np.size(which))
            return np.asarray(self)[which]

    lists.vectors = vectors.view(Counted)
    best, score = lists.search(np.array([3.0, 2, 1, 5]), np.ones(2000, bool), [-(1 << 200)], [1 << 200], np.arange(2000), 5)[0]
    assert best.tolist() == [0, 1, 2, 3, 4] and set(score) == {990.0} and sum(scored) < 200
