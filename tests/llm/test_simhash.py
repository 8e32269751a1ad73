import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm import simhash as S
from folio.llm.components import components

from .conftest import ODD


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_roots(fps):
    roots = {f: f for f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                roots[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("hot", [1, 256])
def test_links(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(base)
    for f in base[:12]:
        for _ in range(8):
            g = f
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                g ^= 1 << int(b)
            fps.add(g)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    frame = spark.createDataFrame([(signed(f),) for f in sorted(fps)], "fp long")
    got = {r["a"]: r["root"] for r in components(S.links(frame)).collect()}
    groups, expected = {}, {}
    for f, r in brute_roots(sorted(fps)).items():
        expected.setdefault(r, set()).add(signed(f))
    for f in map(signed, fps):
        groups.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_allocations_cover_all_links():
    rng = np.random.default_rng(4)
    sample = rng.integers(-(2**63), 2**63, 300)
    for n in (10, 10**5, 10**9):
        probes = S.plan_probes(sample, n)
        assert sum(t + 1 for _, t in probes) == S.DISTANCE + 1
        assert sorted(b for bits, _ in probes for b in bits) == sorted({b for bits, _ in probes for b in bits})
    assert len(S.plan_probes(sample[:0], 0)) >= 1


def test_hot_buckets_are_in_the_price():
    """With skewed bits and very many fingerprints the parts are so chosen that few of them lie in buckets too large to be paired."""
    rng = np.random.default_rng(6)
    bits = (rng.random((1500, 64)) < np.where(np.arange(64) < 24, 0.08, 0.5)).astype("u1")  # a third of the bits says little
    bits[:, 8:16] = bits[:, :8]  # and a part of those says it twice
    sample = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
    n = 10**9
    probes = S.plan_probes(sample, n)
    assert sum(t + 1 for _, t in probes) == S.DISTANCE + 1
    for group, t in probes:
        part = bits[:, group].astype(int)
        apart = part.sum(axis=1)[:, None] + part.sum(axis=1)[None, :] - 2 * part @ part.T
        assert ((apart <= t).sum(axis=1) > 1).mean() < 0.2  # at this size one other in the sample is a hot bucket
    few = S.plan_probes(sample, 10**4)
    assert sum(t + 1 for _, t in few) == S.DISTANCE + 1


def test_query(spark, small, small_docs):
    rows = S.op8_simhash(spark, small).collect()
    prints = {d: brute_fingerprint(t) for d, t in small_docs.items()}
    roots = brute_roots(sorted(set(prints.values())))
    least = {}
    for d, f in prints.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    for r in rows:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == least[roots[prints[r["doc_id"]]]]


def test_odd_rows(spark, folder):
    rows = S.op8_simhash(spark, folder(ODD)).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    docs = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, fp int")
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in S.keep_one(docs).collect())
    assert [k[0] for k in kept] == sorted([-1, 1, 2, 4, 6, 7]) and S.keep_one(docs).columns == docs.columns
    assert S.op8_simhash(spark, folder()).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["a"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{100 + i: 100 for i in range(1, 40)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert F is not None


def test_kept_rows_have_all_their_columns(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    texts = [(1, "one text of some words that is here")] * 40 + [(2, "one text of some words that is here"), (3, "quite another text of other words"), (None, None)]
    names = ["_k1", "_K2", "k1", "sig", "own", "first", "fp", "n", "component_id"]
    odd = spark.createDataFrame(texts, "doc_id long, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    got = S.keep_one(odd)
    assert got.columns == odd.columns and sorted((r["doc_id"] or 0, *[r[c] for c in names]) for r in got.collect()) == [(i, *range(len(names))) for i in (0, 1, 3)]
    found = S.near_duplicates(odd).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 3), (None, None)} and len(found) == len(texts)
