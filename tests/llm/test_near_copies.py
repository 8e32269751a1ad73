import numpy as np
import pytest

from folio.llm import near_copies as N
from folio.llm.simhash import keep_one, proposed, searched


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(docs):
    """The least doc_id of each component of texts with a 5-word-shingle similarity of 0.8 or more."""
    sets = {d: brute_set(t) for d, t in docs.items()}
    roots = {d: d for d in docs}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and (sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))):
                x, y = find(a), find(b)
                roots[max(x, y)] = min(x, y)
    return {find(d) for d in docs}


def changed(rng, words, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{rng.integers(10**9)}"
    return words


@pytest.mark.parametrize("common", [4, 1 << 18])
def test_near_copies(spark, monkeypatch, common):
    monkeypatch.setattr(N, "COMMON", common)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(12):  # single copies with 0 to 6 changed words; the edge lies among them
        base = [f"w{x}" for x in rng.integers(0, 10**6, 60 + 40 * k)]
        texts += [base] + [changed(rng, base, n) for n in (0, 1, 2, 3, 4, 6)]
    hub = [f"h{x}" for x in rng.integers(0, 10**6, 200)]
    texts += [changed(rng, hub, n % 6) for n in range(60)]  # a large group, not all of it alike
    line = [f"c{x}" for x in range(12)]
    texts += [line + [f"u{x}" for x in rng.integers(0, 10**6, 30)] for _ in range(40)]  # a common line in unlike texts
    texts += [line + line[:k] for k in range(12)] + [["a"], ["A"], ["a", "b"], [], []]
    docs = {i: " ".join(t) for i, t in enumerate(texts)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in keep_one(frame).collect()} == brute_kept(docs)


def test_given_table(spark, small, small_docs):
    got = keep_one(spark.read.parquet(f"{small}/documents.parquet"))
    assert {r["doc_id"] for r in got.collect()} == brute_kept(small_docs)


def test_fingerprints_of_sets():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 9, 20_000):
        own = rng.integers(-(2**63), 2**63 - 1, n)
        bits = [(own.view("u8") >> np.uint64(b) & np.uint64(1)).sum() for b in range(64)]
        wanted = sum(1 << b for b in range(64) if 2 * int(bits[b]) > n)
        assert N.set_fingerprint(own) % (1 << 64) == wanted


def test_simhash_proposes_equal_fingerprints(spark):
    """All sets of one fingerprint are proposed with the first of them, and nothing else."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 600)]
        texts += [base, changed(rng, base, 1), changed(rng, base, 1)]
    frame = spark.createDataFrame([(i, i, i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, k1 long, k2 long, text string")
    keys = N.signed(frame, *N.common_shingles(frame)).collect()
    groups = {}
    for r in keys:
        groups.setdefault(r["fp"], set()).add(r["sig"])
    wanted = {(s, min(g)) for g in groups.values() for s in g if s != min(g)}
    nodes = spark.createDataFrame([(r["sig"], r["fp"]) for r in keys], "sig long, fp long")
    assert {tuple(r) for r in proposed(nodes).collect()} == wanted and wanted


def test_boilerplate_that_a_sample_misses(spark, monkeypatch):
    """Shingles of large buckets are counted over all texts and put last, round by round; the kept rows are those of brute force."""
    monkeypatch.setattr(N, "SAMPLE", 1)
    monkeypatch.setattr(N, "BUCKET", 20)
    rng = np.random.default_rng(13)
    passage = [f"p{x}" for x in range(60)]
    texts = [[f"u{x}" for x in rng.integers(0, 10**6, 12)] + passage + [f"v{x}" for x in rng.integers(0, 10**6, 13)] for _ in range(150)]
    texts += [changed(rng, t, 1) for t in texts[:10]] + [passage] * 3
    docs = {i: " ".join(t) for i, t in enumerate(texts)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    keyed = frame.select("doc_id", frame["doc_id"].alias("k1"), frame["doc_id"].alias("k2"), "text")
    buckets = N.nodes_of(keyed).selectExpr("explode(prefix) h").groupBy("h").count()
    assert buckets.agg({"count": "max"}).first()[0] <= 20
    assert {r["doc_id"] for r in keep_one(frame).collect()} == brute_kept(docs)


def test_the_search_proposes_within_three_bits(spark):
    """Sets of other fingerprints are proposed when these differ in at most three bits; before, only equal ones were."""
    rng = np.random.default_rng(11)
    fps = [int(f) for f in rng.integers(-(2**62), 2**62, 40)]
    nodes = [(k, f) for k, f in enumerate(fps)]
    nodes += [(100 + k, f ^ sum(1 << int(b) for b in rng.choice(62, 1 + k % 5, replace=False))) for k, f in enumerate(fps)]
    got = {frozenset(r) for r in searched(spark.createDataFrame(nodes, "sig long, fp long")).collect()}
    assert got == {frozenset((k, 100 + k)) for k in range(40) if 1 + k % 5 <= 3}


def test_shingles_that_become_common(spark, monkeypatch):
    """No sample at all: every large bucket is found over all texts. Before, Spark failed on the first (an attribute that its optimizer lost)."""
    monkeypatch.setattr(N, "common_shingles", lambda docs: (np.empty(0, "<i8"), np.empty(0, "<i8")))
    monkeypatch.setattr(N, "BUCKET", 20)
    calls, signed = [], N.signed
    monkeypatch.setattr(N, "signed", lambda docs, common, often: calls.append((docs.count(), common, often)) or signed(docs, common, often))
    rng = np.random.default_rng(17)
    passage = [f"p{x}" for x in range(60)]
    texts = [[f"u{x}" for x in rng.integers(0, 10**6, 12)] + passage + [f"v{x}" for x in rng.integers(0, 10**6, 13)] for _ in range(60)]
    texts += [[f"w{x}" for x in rng.integers(0, 10**6, 50)] for _ in range(40)]
    texts += [changed(rng, t, 1) for t in texts[55:65]] + [passage] * 3
    docs = {i: " ".join(t) for i, t in enumerate(texts)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    keyed = frame.select("doc_id", frame["doc_id"].alias("k1"), (-frame["doc_id"]).alias("k2"), "text")
    nodes = {r["sig"]: (tuple(r["first"]), r["k1"], r["k2"], r["size"], r["fp"], r["prefix"]) for r in N.nodes_of(keyed).collect()}
    # the texts of the passage, and no others, are signed again, and all as under the last order from the start
    assert len(calls) > 1 and all(60 <= c[0] < 80 for c in calls[1:]), [c[0] for c in calls]
    wanted = {}
    for r in signed(keyed, *calls[-1][1:]).orderBy("doc_id").collect():
        wanted.setdefault(r["sig"], ((False, r["k1"], r["k2"]), r["k1"], r["k2"], r["size"], r["fp"], r["prefix"]))
    assert nodes == wanted
    assert {r["doc_id"] for r in keep_one(frame).collect()} == brute_kept(docs)
