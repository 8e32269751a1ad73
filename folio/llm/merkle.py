"""Operator 3: Merkle fingerprints of documents, in DataFrame functions only.

A paragraph (line) is cut into leaves: pieces of sentences of at most ``LEAF_CHARS`` characters. All nodes are SHA-256: a leaf's
of its text, a paragraph's of its leaves, a section's of its paragraphs, the root's of its sections. A section ends where a
paragraph's own hash says so, about every fourth time, or at an empty paragraph, so that an insertion moves only the sections
near it. The fingerprint is

    root ; section ( leaf . leaf , leaf . leaf ) ; section ( ... )

with the paragraphs of a section divided by commas, and of leaves and sections the first 16 and 32 digits. Equal roots mean equal
texts. Two fingerprints are compared from the top: where the roots are equal there is nothing to do; of the sections only those
that the other does not have are opened, of their paragraphs again only those that differ, and only of these the leaves are
matched. The share of leaves in what is common is the likeness, the sections left over locate the edit (:func:`compared`).
Each level is one hash-based array operation, so the work is linear in the texts.

Cases: a null text counts as empty: no leaves, and alike (1.0) only to other empty texts; very long texts are hashed and compared
in linear time; rows equal in doc_id and text are one document with one successor, and every such row is returned; rows equal
only in doc_id are ordered by a hash of their text; null doc_ids come last in descending order; the successor of a single
document is itself; only doc_id and text are read, so other columns may have any name; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import table, text_or_empty, written

LEAF_CHARS = 64
#: Documents in one range of ids whose order a task finds, and the most ranges there are.
RANGE_DOCS, MOST_RANGES = 2_000, 1024


def with_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as ``out``. Scratch columns start with ``_m_``."""
    leaf = F.lit(rf"[^.!?]{{1,{LEAF_CHARS}}}[.!?]*|[.!?]+")
    digest = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    nodes = docs.withColumn("_m_leaf", F.transform(F.split(F.col(text), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, leaf, F.lit(0)), digest)))
    shown = lambda p: F.array_join(F.transform(p, lambda x: F.left(x, F.lit(16))), ".")
    nodes = nodes.withColumn("_m_par", F.transform("_m_leaf", lambda p: F.struct(digest(F.array_join(p, "")).alias("node"), shown(p).alias("body"))))
    last = F.size("_m_par")
    # of SHA-256 the last digit is as good as any: a quarter of all paragraphs end a section
    closes = lambda i: (i == last) | F.get("_m_par", i - 1)["node"].substr(64, 1).isin("0", "1", "2", "3") | (F.get("_m_par", i - 1)["body"] == "")
    nodes = nodes.withColumn("_m_end", F.filter(F.sequence(F.lit(1), last), closes))
    start = lambda k: F.when(k == 0, 1).otherwise(F.get("_m_end", k - 1) + 1)
    nodes = nodes.withColumn("_m_part", F.transform("_m_end", lambda e, k: F.slice("_m_par", start(k), e - start(k) + 1)))
    section = lambda ps: F.struct(digest(F.array_join(F.transform(ps, lambda p: p["node"]), "")).alias("node"), F.array_join(F.transform(ps, lambda p: p["body"]), ",").alias("body"))
    nodes = nodes.withColumn("_m_section", F.transform("_m_part", section))
    root = digest(F.array_join(F.transform("_m_section", lambda s: s["node"]), ""))
    sections = F.transform("_m_section", lambda s: F.concat(F.left(s["node"], F.lit(32)), F.lit("("), s["body"], F.lit(")")))
    return nodes.withColumn(out, F.concat_ws(";", root, F.array_join(sections, ";"))).drop("_m_leaf", "_m_par", "_m_end", "_m_part", "_m_section")


def compared(rows: DataFrame, old: str, new: str, like: str, changed: str) -> DataFrame:
    """``rows`` with the likeness (0 to 1) of two fingerprint columns as ``like``, and as ``changed`` the nodes of the sections of
    ``new`` that ``old`` does not have. Scratch columns start with ``_m_``."""
    root = lambda f: F.substring_index(f, ";", 1)
    sections = lambda f: F.array_distinct(F.slice(F.split(f, ";"), 2, 1 << 30))
    body = lambda s: F.substring_index(F.substring_index(s, "(", -1), ")", 1)
    opened = lambda parts: F.array_distinct(F.filter(F.flatten(F.transform(parts, lambda s: F.split(body(s), ","))), lambda p: p != ""))
    leaves = lambda parts: F.array_distinct(F.flatten(F.transform(parts, lambda p: F.split(p, "[.]"))))
    n_leaves = lambda parts: F.aggregate(parts, F.lit(0), lambda n, s: n + (F.char_length(F.translate(body(s), ".,", "")) / 16).cast("int"))
    n_in = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.size(F.split(p, "[.]")))
    same = root(F.col(old)) == root(F.col(new))
    none = F.array().cast("array<string>")
    # below equal roots nothing is opened
    rows = rows.withColumn("_m_a", F.when(same, none).otherwise(sections(F.col(old)))).withColumn("_m_b", F.when(same, none).otherwise(sections(F.col(new))))
    rows = rows.withColumn("_m_both", F.array_intersect("_m_a", "_m_b"))
    rows = rows.withColumn("_m_a", F.array_except("_m_a", "_m_both")).withColumn("_m_b", F.array_except("_m_b", "_m_both"))
    rows = rows.withColumn(changed, F.transform("_m_b", lambda s: F.substring_index(s, "(", 1))).withColumn("_m_n", n_leaves(F.col("_m_both")))
    rows = rows.withColumn("_m_a", opened(F.col("_m_a"))).withColumn("_m_b", opened(F.col("_m_b"))).withColumn("_m_both", F.array_intersect("_m_a", "_m_b"))
    rows = rows.withColumn("_m_n", F.col("_m_n") + n_in(F.col("_m_both")))
    rows = rows.withColumn("_m_a", leaves(F.array_except("_m_a", "_m_both"))).withColumn("_m_b", leaves(F.array_except("_m_b", "_m_both")))
    common, total = F.col("_m_n") + F.size(F.array_intersect("_m_a", "_m_b")), 2 * F.col("_m_n") + F.size("_m_a") + F.size("_m_b")
    return rows.withColumn(like, F.when(same | (total == 0), 1.0).otherwise(2.0 * common / total)).drop("_m_a", "_m_b", "_m_both", "_m_n")


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and a key ``(k1, k2)`` without nulls: the id, and a hash of the text and of the id being null."""
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("k1"), F.xxhash64(F.col("doc_id").isNull(), text).alias("k2"))


def successors(keyed: DataFrame) -> DataFrame:
    """``k1, k2, n1, n2``: for each document the key of the next in descending doc_id; after the last comes the first.

    Ids are dealt into ranges of their order, ordered within each, and the ranges are tied by their heads, of which there are at
    most as many as ranges. Only ids and hashes move.
    """
    ranges = max(1, min(MOST_RANGES, -(-keyed.count() // RANGE_DOCS)))
    order = [F.desc_nulls_last("doc_id"), F.desc("k2")]
    ids = keyed.select("doc_id", "k1", "k2").distinct().repartitionByRange(ranges, *order)
    # written, so that every later job sees the same ranges
    ranged = written(ids.withColumn("range", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "k2", "k1")).alias("head")).orderBy("range").collect()  # one row a range
    if not heads:
        return ranged.select("k1", "k2", F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    rows = [(r["range"], *(heads[(i + 1) % len(heads)]["head"][k] for k in ("k1", "k2"))) for i, r in enumerate(heads)]
    after = keyed.sparkSession.createDataFrame(rows, "range int, h1 long, h2 long")
    ordered = Window.partitionBy("range").orderBy(*order)
    led = ranged.select("range", "k1", "k2", F.lead("k1").over(ordered).alias("l1"), F.lead("k2").over(ordered).alias("l2"))
    # one row a range: broadcast by that bound
    return led.join(F.broadcast(after), "range").select("k1", "k2", F.coalesce("l1", "h1").alias("n1"), F.coalesce("l2", "h2").alias("n2"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``fingerprint`` (replaced if it was there)."""
    kept = [c for c in docs.columns if c.lower() != "fingerprint"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), text_or_empty().alias("text"))  # no name clashes
    return with_fingerprint(rows, "text", "fingerprint").select(*[F.col(f"own.`{c}`").alias(c) for c in kept], "fingerprint")


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed(table(spark, sf_dir, "documents"))
    next_of = successors(keyed)
    # what each document gets from its successor: at most a third of its own length, so little text moves for it
    own_size = keyed.select("k1", "k2", F.floor(F.char_length("text") / 3).cast("int").alias("taken")).distinct()
    wanted = next_of.join(own_size, ["k1", "k2"]).select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("t1"), F.col("k2").alias("t2"), "taken")
    # both joins read the same columns of the texts, so that one shuffle of them serves both; fingerprints are made after it
    given = with_fingerprint(keyed.join(wanted, ["k1", "k2"]), "text", "next_fingerprint")
    given = given.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.expr("left(text, taken)").alias("given"), "next_fingerprint", F.col("doc_id").alias("next_doc_id"))
    both = keyed.join(given.dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 3) AS int))"), "given"))
    both = with_fingerprint(with_fingerprint(both, "text", "fingerprint"), "edited", "edited_fingerprint")
    both = compared(both, "fingerprint", "edited_fingerprint", "near_edited", "edited_sections")
    both = compared(both, "fingerprint", "next_fingerprint", "near_next", "_m_next")
    edited = F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    return both.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_sections", "next_doc_id")
