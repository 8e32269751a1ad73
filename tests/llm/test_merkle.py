import hashlib
import re

from pyspark.sql import functions as F

from folio.llm.merkle import LEAF_CHARS, compared, fingerprints, op3_merkle

from .conftest import ODD


def test_query(spark, small, small_docs):
    order = sorted(small_docs, reverse=True)
    after = {a: order[(i + 1) % len(order)] for i, a in enumerate(order)}
    by_text = {}
    for r in op3_merkle(spark, small).collect():
        text, given = small_docs[r["doc_id"]], small_docs[after[r["doc_id"]]]
        k = len(text) // 3
        edited = text[: len(text) - k] + given[:k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1) == (edited == text)
        if len(text) > 1000:
            assert r["near_edited"] > 0.4 and (r["near_next"] < 0.3 or given[:50] in text)
    assert len(set(by_text.values())) == len(by_text)


def test_odd_rows(spark, folder):
    rows = op3_merkle(spark, folder(ODD)).collect()
    assert len(rows) == len(ODD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    nexts = {(r["doc_id"], r["n_chars"]): r["next_doc_id"] for r in rows}
    assert nexts[7, 8] == 6 and nexts[5, 14] == 4 and nexts[4, 14] == 3 and nexts[1, 0] is None and nexts[None, 7] == 7
    assert {nexts[2, 0], nexts[2, 19]} == {2, 1}
    only = op3_merkle(spark, folder([(1, "one. two. three.")])).first()
    assert only["next_doc_id"] == 1 and only["near_next"] == 1.0
    assert op3_merkle(spark, folder()).count() == 0


LEAF = re.compile(rf"[^.!?]{{1,{LEAF_CHARS}}}[.!?]*|[.!?]+")


def tree(text):
    """Sections of paragraphs of leaf digests, and all nodes, by plain recursion."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    paragraphs = [[sha(x) for x in LEAF.findall(line)] for line in text.split("\n")]
    sections, now = [], []
    for k, p in enumerate(paragraphs):
        now.append(p)
        if not p or sha("".join(p))[-1] in "0123" or k == len(paragraphs) - 1:
            sections.append(now)
            now = []
    nodes = [sha("".join(sha("".join(p)) for p in s)) for s in sections]
    shown = [node[:32] + "(" + ",".join(".".join(x[:16] for x in p) for p in s) + ")" for node, s in zip(nodes, sections)]
    return ";".join([sha("".join(nodes)), *shown])


def like(a, b):
    """Likeness and changed sections, from the top of two fingerprints down."""
    (root_a, *sec_a), (root_b, *sec_b) = a.split(";"), b.split(";")
    if root_a == root_b:
        return 1.0, []
    once = lambda xs: list(dict.fromkeys(xs))
    body = lambda s: s[s.index("(") + 1 : -1]
    leaves = lambda ps: {x for p in ps for x in p.split(".")}
    both = set(sec_a) & set(sec_b)
    common = sum(len(p.split(".")) for s in both for p in body(s).split(",") if p)
    rest_a, rest_b = ({p for s in set(sec) - both for p in body(s).split(",") if p} for sec in (sec_a, sec_b))
    common += sum(len(p.split(".")) for p in rest_a & rest_b)
    left, right = leaves(rest_a - rest_b), leaves(rest_b - rest_a)
    total = 2 * common + len(left) + len(right)
    return 2 * (common + len(left & right)) / total if total else 1.0, [s[:32] for s in once(sec_b) if s not in both]


def test_against_a_plain_tree(spark, small, small_docs):
    prints = {d: tree(t) for d, t in small_docs.items()}
    order = sorted(small_docs, reverse=True)
    after = {a: order[(i + 1) % len(order)] for i, a in enumerate(order)}
    for r in op3_merkle(spark, small).collect():
        d, text = r["doc_id"], small_docs[r["doc_id"]]
        edited = tree(text[: len(text) - len(text) // 3] + small_docs[after[d]][: len(text) // 3])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[d], edited)
        near, changed = like(prints[d], edited)
        assert (r["near_edited"], r["edited_sections"]) == (near, changed)
        assert r["near_next"] == like(prints[d], prints[after[d]])[0]


def test_edits_are_located(spark):
    old = "\n\n".join(f"Paragraph {i} says something. And more of {i}." for i in range(40))
    new = old.replace("something. And more of 21", "nothing. And more of 21")
    rows = fingerprints(spark.createDataFrame([(old, new)], "text string, new string").withColumn("fingerprint", F.lit(0))).select("new", F.col("fingerprint").alias("old"))
    rows = fingerprints(rows.withColumnRenamed("new", "text"))
    first = compared(compared(rows, "old", "fingerprint", "near", "changed"), "old", "old", "self", "none").first()
    sections = first["fingerprint"].split(";")[1:]
    assert len(first["changed"]) == 1 and first["none"] == [] and first["self"] == 1.0 and len(sections) > 20
    (at,) = [k for k, s in enumerate(sections) if s.startswith(first["changed"][0])]
    assert 0.9 < first["near"] < 1 and first["near"] == like(tree(old), tree(new))[0] and sections[:at] == first["old"].split(";")[1 : at + 1]
