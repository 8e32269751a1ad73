from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from folio.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", s, 0) for i, s, t in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def brute_targets(sizes, weights, epochs=3):
    """Clamp and share again, in fractions."""
    targets, free, left = {}, {s for s in sizes if weights.get(s)}, sum(sizes.values())
    while free:
        level = Fraction(left, sum(weights[s] for s in free))
        over = {s for s in free if level * weights[s] >= epochs * sizes[s]}
        if not over:
            return targets | {s: float(level * weights[s]) for s in free} | {s: 0.0 for s in sizes if not weights.get(s)}
        for s in over:
            targets[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
        free -= over
    return targets | {s: 0.0 for s in sizes if not weights.get(s)}


def agrees(rows, weights):
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] == r["size"] * r["repeats"] and 0 <= r["repeats"] <= 3
    targets = brute_targets(dict(sizes), weights)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= most[s] / 2 + 1e-6, (s, taken[s], targets[s])


ROWS = [
    *[(i, "big", "w " * (i % 40)) for i in range(300)],
    *[(1000 + i, "small", "one two three") for i in range(4)],
    *[(2000 + i, "Zed", "word " * (1 + i % 7)) for i in range(60)],
    *[(3000 + i, None, f"a b\x1cc d{i}") for i in range(20)],
    *[(4000 + i, "", f"x y z {i}") for i in range(20)],
    (5000, "none", None), (5001, "none", " \n"), (None, "big", "no id"), (7, "big", "other text of id 7"), (6000, "long", "token " * 3_000),
]


def test_against_brute_force(spark, tmp_path):
    folder = put(spark, tmp_path, ROWS)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    order = sorted({s for _, s, _ in ROWS if s is not None}) + [None]
    rows = M.mix(docs).collect()
    assert len(rows) == len(ROWS)
    agrees(rows, {s: k % 3 + 1 for k, s in enumerate(order)})
    query = {(r["doc_id"], r["size"], r["taken"]) for r in M.op11_mixing(spark, folder).collect()}
    assert query == {(r["doc_id"], r["size"], r["taken"]) for r in rows}
    again = {(r["doc_id"], r["size"], r["taken"]) for r in M.mix(docs.repartition(5)).collect()}
    assert again == query
    other = {(r["doc_id"], r["size"], r["taken"]) for r in M.mix(docs, seed=7).collect()}
    assert other != query


def test_given_weights_and_repetitions(spark, tmp_path):
    docs = spark.read.parquet(f"{put(spark, tmp_path, ROWS)}/documents.parquet")
    weights = {"small": 1000, "Zed": 5, "long": 0, None: 1}
    given = spark.createDataFrame(list(weights.items()), "source string, weight long")
    mixed = M.mix(docs, given)
    rows = mixed.collect()
    agrees(rows, weights)
    assert {r["target"] for r in rows if r["source"] == "small"} == {36.0} and sum(r["taken"] for r in rows if r["source"] in ("big", "long", "")) == 0
    out = M.repeated(mixed)
    assert out.count() == sum(r["repeats"] for r in rows) and out.agg(F.sum("size")).first()[0] == sum(r["taken"] for r in rows)
    assert sum(r["taken"] for r in M.mix(docs, given, budget=0).collect()) == 0


def test_equal_rows_at_the_cut(spark, tmp_path):
    rows = [(1, "a", "same four words here")] * 400 + [(2, "b", "one")] * 3 + [(i, "c", "x y") for i in range(500)]
    folder = put(spark, tmp_path, rows)
    got = M.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    agrees(got, {"a": 1, "b": 2, "c": 3})
    of_a = sorted(r["repeats"] for r in got if r["source"] == "a")
    assert set(of_a) == {0, 1}
    assert sorted(map(tuple, M.op11_mixing(spark, folder).collect())) == sorted(map(tuple, M.op11_mixing(spark, folder).collect()))


def test_many_sources_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "MOST_HOT", 2)
    docs = spark.read.parquet(f"{put(spark, tmp_path, ROWS)}/documents.parquet")
    order = sorted({s for _, s, _ in ROWS if s is not None}) + [None]
    agrees(M.mix(docs).collect(), {s: k % 3 + 1 for k, s in enumerate(order)})


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{put(spark, tmp_path, ROWS)}/documents.parquet")
    names = ["_tag", "_KEY", "_plan", "n", "tag", "key", "head", "whole", "_task", "_here", "_place", "cut", "some"]
    odd = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)], F.lit("mine").alias("target"))
    got = M.mix(odd)
    assert set(names) < set(got.columns) and got.columns.count("target") == 1
    row = got.where("doc_id = 9").first()
    assert [row[c] for c in names] == list(range(len(names))) and isinstance(row["target"], float)
    same = [(1, "a", "x")] * 9 + [(2, "b", "y " * 40)]
    odd = spark.createDataFrame([(i, t, s, 1, 2) for i, s, t in same], "doc_id long, text string, source string, _here int, _task int")
    assert sorted(M.mix(odd).columns) == sorted([*odd.columns, *M.RESULTS]) and M.mix(odd).count() == 10
    assert M.op11_mixing(spark, put(spark, tmp_path / "none", [])).count() == 0
    blank = M.op11_mixing(spark, put(spark, tmp_path / "blank", [(1, "a", None), (2, None, "")])).collect()
    assert {(r["size"], r["source_size"], r["target"], r["taken"]) for r in blank} == {(0, 0, 0.0, 0)}
