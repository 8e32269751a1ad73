"""Operator 8: SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints of 64 bits link if they differ in at most 3. The bits are dealt into parts so that correlated bits share one;
with thresholds ``t`` of the parts that satisfy ``sum(t + 1) = 3 + 1``, any two linked fingerprints differ in some part by at
most its ``t`` bits (``t = -1``: the part is not probed). A dynamic programme picks the thresholds with the least estimated
work. Each fingerprint is then indexed under its bits of each probed part and probes the keys within ``t`` bits; buckets are
verified exactly. The parts and thresholds only steer the work: every choice finds every link.

Buckets with more than ``HOT`` fingerprints are never paired: their members are linked through shared neighbours instead. A
value ``c`` within one bit of fingerprint ``a`` links ``a`` to every fingerprint within two bits of ``c``; all pairs within 3
bits have such a ``c``, and no value has more than 65 + 2016 fingerprints near it. Equal fingerprints are one node throughout.

Cases: texts without words (null, empty, blank) have fingerprint zero; fewer than three words are one shingle; repeated rows
and ties are linked like other equal texts; very long texts are hashed whole, in linear time; null doc_ids are not used as component ids unless a component has no other; only
doc_id and text are read, so other columns may have any name; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import near_copies
from folio.llm.common import hash_sample, removed, table, unskewed, very_frequent, written
from folio.llm.components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: About so many fingerprints at most, those with the smallest hashes; they only steer the parts and thresholds.
SAMPLE = 2048
#: Largest bucket that is verified pair by pair, and the values within two bits of a fingerprint, that a member of a larger one takes.
HOT, NEIGHBOURS = 256, 1 + 64 + 64 * 63 // 2


def text_fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one whole text as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: lowers A-Z only, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    width = min(shingle, len(words))
    count = np.zeros(BITS, "int64")
    total = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, 8192):
        upto = min(at + 8192, total)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at:upto], stops[at + width - 1 : upto + width - 1], strict=True)], "<u8")
        count += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * count > total, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([text_fingerprint(t or "", shingle) for t in texts.to_pylist()], pa.int64())

    return of(text)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view("u1").reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bit numbers in ``parts`` groups of equal size: each group grows by the bit that goes best with those it has."""
    if len(sample) < 2:
        return [list(range(k, BITS, parts)) for k in range(parts)]
    b = _bits(sample).astype("float64")
    b -= b.mean(axis=0)
    spread = np.sqrt((b * b).sum(axis=0)) + 1e-9
    like = np.abs(b.T @ b) / np.outer(spread, spread)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(free, key=lambda i: like[i, free].sum())]
        free.remove(group[0])
        while len(group) < size:
            nearest = max(free, key=lambda i: like[i, group].sum())
            group.append(nearest)
            free.remove(nearest)
        out.append(sorted(group))
    return out


def allocate(sample: np.ndarray, groups: list[list[int]], n: int) -> tuple[float, list[int]]:
    """Thresholds with the least estimated work, by dynamic programming: rows probed, candidate pairs at their lesser price, and
    the rows that members of hot buckets take."""
    b = _bits(sample) if len(sample) else np.zeros((1, BITS), "u1")
    pairs = max(1, len(b) * (len(b) - 1) // 2)
    work = []
    for group in groups:
        part = b[:, group].astype("float32")
        apart = part.sum(axis=1)[:, None] + part.sum(axis=1)[None, :] - 2 * part @ part.T
        row = [0.0]
        for t in range(DISTANCE + 1):
            probes = sum(math.comb(len(group), k) for k in range(t + 1))
            near = (apart < t + 0.5).sum(axis=1) - 1.0  # of each fingerprint of the sample, without itself
            chance = probes / 2.0 ** len(group)
            # members of a bucket that is too large to be paired take NEIGHBOURS rows each instead
            size = n * np.maximum(near / max(1, len(b) - 1), chance)
            hot = float((size > HOT).mean())
            row.append(n * probes + 0.1 * max(near.sum() / 2 / pairs, chance) * n * min(n, HOT) / 2 + hot * n * NEIGHBOURS)
        work.append(row)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in work:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for more, price in enumerate(row):
                if used + more <= DISTANCE + 1 and (used + more not in step or cost + price < step[used + more][0]):
                    step[used + more] = (cost + price, [*chosen, more - 1])
        best = step
    return best[DISTANCE + 1]


def plan_probes(sample: np.ndarray, n: int) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each probed part: the cheapest over 2, 3 and 4 parts."""
    options = []
    for parts in (2, 3, 4):
        groups = correlated_parts(sample, parts)
        cost, thresholds = allocate(sample, groups, n)
        options.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(options)
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


def _flips(bits: list[int], most: int, least: int = 0) -> np.ndarray:
    """Masks of all choices of ``least`` to ``most`` of these bits."""
    masks = [sum(1 << i for i in chosen) for k in range(least, most + 1) for chosen in combinations(bits, k)]
    return np.array(masks, "<u8").view("<i8")


def _signatures(fps: DataFrame, probes: list[tuple[list[int], int]]) -> DataFrame:
    """``(part, key, own, fp)``: each fingerprint under its own key of every part, and under the keys it probes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for k, (bits, t) in enumerate(probes):
                mask, flips = _flips(bits, len(bits), len(bits))[0], _flips(bits, t)
                step = max(1, 100_000 // len(flips))
                for at in range(0, len(values), step):
                    some = values[at : at + step]
                    keys = ((some & mask)[:, None] ^ flips[None, :]).ravel()
                    own = np.tile(flips == 0, len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, "i4")), pa.array(keys), pa.array(own), pa.array(np.repeat(some, len(flips)))], ["part", "key", "own", "fp"])

    return fps.mapInArrow(rows, "part int, key long, own boolean, fp long")


def _bucket_links(buckets: pa.Array) -> pa.Array:
    """Edges that join what is linked within each bucket (a spanning forest, not all pairs)."""
    out = []
    flat, ends = buckets.values.to_numpy(zero_copy_only=False), buckets.offsets.to_numpy()
    for i, j in zip(ends[:-1], ends[1:], strict=True):
        fps = np.unique(flat[i:j])
        edges: list[dict] = []
        if len(fps) > 1:
            bits = fps.view("u8")  # counted unsigned: of negative numbers the count would be that of their absolute value
            near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= DISTANCE
            left = np.ones(len(fps), bool)
            while left.any():
                first = int(left.argmax())
                seen = np.zeros(len(fps), bool)
                seen[first] = True
                while (wider := near[seen].any(axis=0)).sum() > seen.sum():
                    seen = wider
                left &= ~seen
                edges += [{"a": int(x), "b": int(fps[first])} for x in fps[seen] if x != fps[first]]
        out.append(edges)
    return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def _hot_links(fps: DataFrame) -> DataFrame:
    """Edges among fingerprints of hot buckets through shared neighbours; work is linear in their number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = _flips(list(range(BITS)), 2)
        near = np.bitwise_count(flips.view("u8")) <= 1
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 64):
                some = values[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ flips[None, :]).ravel()), pa.array(np.tile(near, len(some))), pa.array(np.repeat(some, len(flips)))], ["c", "near", "fp"])

    around = fps.mapInArrow(rows, "c long, near boolean, fp long")
    # at most 65 + 2016 fingerprints lie within two bits of a value
    grouped = around.groupBy("c").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.collect_list("fp").alias("fps"))
    return grouped.where("b is not null and size(fps) > 1").select(F.explode("fps").alias("a"), "b").where("a != b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints whose closure is that of all links of at most 3 bits."""
    n = fps.count()
    sample = np.sort(np.array([r[0] for r in hash_sample(fps.select("fp"), SAMPLE, "fp").collect()], "<i8"))
    signatures = written(_signatures(fps.select("fp"), plan_probes(sample, n)), "signatures")
    sizes = signatures.groupBy("part", "key").agg(F.count("*").alias("size"), F.max("own").alias("owned")).where("size > 1 and owned")
    sizes = written(sizes.select("part", "key", "size", F.col("size").alias("n")), "buckets")
    # one key may be that of a third of the fingerprints
    members = written(unskewed(signatures, sizes, ["part", "key"], ["fp"]), "members")
    removed(signatures, sizes)
    buckets = members.where(F.col("size") <= HOT).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    cold = buckets.select(F.explode(F.arrow_udf(_bucket_links, "array<struct<a: long, b: long>>")("fps")).alias("e")).select("e.a", "e.b").distinct()
    hot = members.where(F.col("size") > HOT).select("fp").distinct()
    return cold.union(_hot_links(hot))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``."""
    fps = written(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.select("fp")))
    roots = found.withColumnRenamed("a", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    of_fp = unskewed(rooted, least, ["root"], ["fp"], "members").select("fp", "component_id", "n")
    of_fp = written(of_fp, "components")
    removed(nodes, found)
    # equal texts share a fingerprint: any number of rows may have one
    return unskewed(fps, of_fp, ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def proposed(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes(sig, fp)``: each with the first node of its fingerprint."""
    first = written(nodes.groupBy("fp").agg(F.min("sig").alias("rep"), F.count("*").alias("n")).where("n > 1"), "fingerprints")
    return unskewed(nodes.select("sig", "fp"), first, ["fp"], ["sig"]).where("sig != rep").select(F.col("sig").alias("a"), F.col("rep").alias("b"))


def searched(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes(sig, fp)`` with other fingerprints: what the pigeonhole search links within three bits, each
    fingerprint by its first node. Of a bucket these are the edges of a forest, not all pairs."""
    first = written(nodes.groupBy("fp").agg(F.min("sig").alias("rep")), "firsts")
    side = lambda x: first.select(F.col("fp").alias(f"f{x}"), F.col("rep").alias(x))
    edges = links(first.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    return edges.join(side("a"), "fa").join(side("b"), "fb").select("a", "b")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies (5-word shingles, similarity 0.8 or more; see ``near_copies``): of
    its documents that with the least (doc_id, text hash), ids before null.

    Who stays is settled on narrow rows: the keys are joined to the texts once, at the end.
    """
    k1, k2 = F.coalesce("doc_id", F.lit(0)).cast("long"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    nodes = near_copies.nodes_of(keyed)
    edges = near_copies.links(nodes, keyed, proposed(nodes).union(searched(nodes)))
    found = components(edges)
    roots = found.withColumnRenamed("a", "sig")
    least = nodes.join(roots, "sig", "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("first").alias("first"))
    stay = written(least.select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")), "stay")
    removed(nodes, edges, found)
    keys = ["k1", "k2"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), k1.alias("k1"), k2.alias("k2"))
    hot = very_frequent(rows.select(*keys), keys)
    if hot is not None:  # of a million equal rows one goes to the join
        rows = rows.join(hot, keys, "left_anti").unionByName(rows.join(hot, keys, "left_semi").dropDuplicates(keys))
    met = rows.join(stay, keys).dropDuplicates(keys)
    return met.select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
