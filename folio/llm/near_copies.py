"""Near copies of the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, found exactly.

SimHash (operator 8) proposes the pairs whose fingerprints, here of these shingles, are equal or linked by the pigeonhole search within
three bits; their texts are compared, and what is alike is one group from then on. As a fingerprint of 64 bits cannot tell 0.8 from less, the rest is found by a
prefix-filtered self-join among what is not in one group yet: under one global order of the shingles, two sets of that similarity
share one of the first ``size - ceil(0.8 size) + 1`` shingles of each. The order is by hash, but common shingles come last, by
their frequency: those of a sample, and then those whose buckets, over all texts, turn out to be large. For these the order is
settled again, until no other is left, so that texts meet by what they share with few. The order only steers the work, every order
finds every pair. Equal sets are one node throughout.

Within a bucket (the nodes with one prefix shingle) all are first compared with its least changed node, that with the fewest
rarer shingles; then only pairs that this did not join are, so that a large group of near copies costs a comparison a member.
Pairs go by size, by place of the shingle, and by a parity sketch: the sketches of two sets differ in no more bits than the sets
differ in shingles. Each of the three only drops pairs that cannot reach the similarity, and all are conditions of the join, so
that only what passes them leaves it. Buckets of many nodes are dealt over several tasks. What stays quadratic is the number of
sketches that are compared among nodes of a bucket that are alike, but neither to its least changed one nor enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import few_or_shuffled, hash_sample, release, removed, unskewed, written
from folio.llm.components import components

WIDTH, SEED = 5, 42
#: About so many texts at most, and so many of their repeated shingles, settle what is common; they only steer the order.
SAMPLE, COMMON = 20_000, 1 << 18
#: Buckets of more nodes than this make their shingle a common one.
BUCKET = 128
#: Longs of the parity sketch.
SKETCH = 8


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of one whole text; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: lowers A-Z only, splits at ASCII white space
    if not words:
        return np.empty(0, "<i8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - width + 1], stops[width - 1 :], strict=True)]
    return np.unique(np.array(hashes, "<u8").view("<i8"))


def prefix_size(size: int) -> int:
    return size - (4 * size + 4) // 5 + 1 if size else 0


def alike(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with ``common`` elements in common reach 0.8, in whole numbers."""
    return 9 * common >= 4 * (a + b)


def set_fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes, as a signed 64-bit number; 0 of the empty set."""
    count = np.zeros(64, "int64")
    for at in range(0, len(own), 8192):
        count += np.unpackbits(own[at : at + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * count > len(own), bitorder="little").view("<i8")[0])


def _sets(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        out = pa.array([shingle_set(t.as_py() or "") for t in texts], pa.list_(pa.int64()))
        release()
        return out

    return of(text)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most repeated shingles of a sample, sorted, and in how many of its texts each stands."""
    rows = hash_sample(docs.select("doc_id", "text"), SAMPLE, "doc_id", "text").select(F.explode(_sets(F.col("text"))).alias("h"))
    most = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes, counts = most["h"].to_numpy(), most["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def signed(docs: DataFrame, common: np.ndarray, often: np.ndarray) -> DataFrame:
    """``(doc_id, k1, k2, sig, size, prefix, sketch, fp)`` for every row of ``docs(doc_id, k1, k2, text)``, with the shingles
    ``common`` last, by how often they are there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sizes, prefixes, sketches, fps = [], [], [], [], []
            for text in batch.column(3):
                own = shingle_set(text.as_py() or "")
                rank = np.zeros(len(own), "int64")
                if len(common) and len(own):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    rank = np.where(common[at] == own, often[at], 0)
                sigs.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(set_fingerprint(own))
                prefixes.append(own[np.lexsort((own, rank))[: prefix_size(len(own))]])
                parity = np.bincount(own & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
                sketches.append(np.packbits(parity.astype("u1"), bitorder="little").view("<i8"))
            lists = pa.list_(pa.int64())
            out = [pa.array(np.array(sigs, "<u8").view("<i8")), pa.array(sizes, pa.int32()), pa.array(prefixes, lists), pa.array(sketches, lists), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *out], ["doc_id", "k1", "k2", "sig", "size", "prefix", "sketch", "fp"])
            release()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, k1 long, k2 long, sig long, size int, prefix array<long>, sketch array<long>, fp long"
    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(rows, schema)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts have the similarity; ``docs(k1, k2, text)``."""
    side = lambda x: nodes.select(F.col("sig").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    apart, size = _apart(F.col("sketch_a"), F.col("sketch_b")), F.col("size_a") + F.col("size_b")
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where((5 * F.least("size_a", "size_b") >= 4 * F.greatest("size_a", "size_b")) & (9 * apart <= size))
    near = written(near.select("a", "b"), "near")
    wanted = near.select(F.col("a").alias("sig")).union(near.select(F.col("b").alias("sig"))).distinct()
    places = nodes.join(wanted, "sig").select("sig", "k1", "k2")
    # rows equal in both keys have one text
    sets = docs.join(places, ["k1", "k2"]).select("sig", "text").withColumn("own", _sets(F.col("text"))).select("sig", "own")
    sets = written(sets, "shingles")
    once = sets.dropDuplicates(["sig"])
    own = lambda x: once.select(F.col("sig").alias(x), F.col("own").alias(f"own_{x}"))
    met = near.join(own("a"), "a").join(own("b"), "b")
    out = written(met.where(alike(F.size(F.array_intersect("own_a", "own_b")), F.size("own_a"), F.size("own_b"))).select("a", "b"), "links")
    removed(near, sets)
    return out


def _apart(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _most_frequent(shingles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``h`` that more than ``BUCKET`` rows have, and how many; those of the most rows if they are very many."""
    counts = shingles.groupBy("h").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") > BUCKET).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    return found["h"].to_numpy(), found["n"].to_numpy()


def _more_common(nodes: DataFrame, docs: DataFrame, common: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The shingles that ``common`` lacks, sorted, and how often they are there; None if no bucket but those of common shingles is large.

    A shingle of a large bucket stands in a passage that many texts share, so of the texts of such buckets all shingles are counted:
    the passage's others would be the next to make large buckets.
    """
    hashes, _ = _most_frequent(nodes.select(F.explode("prefix").alias("h")))
    hashes = hashes[~np.isin(hashes, common)]
    if not len(hashes) or len(common) > 4 * COMMON:
        return None
    texts = written(_with_any(nodes, hashes), "shared-texts")
    of_texts = docs.join(few_or_shuffled(texts.select("k1", "k2"), texts.count()), ["k1", "k2"], "left_semi")
    new, counts = _most_frequent(of_texts.select(F.explode(_sets(F.col("text"))).alias("h")))
    removed(texts)
    fresh = ~np.isin(new, common)
    every = np.concatenate([new[fresh], hashes])
    every, first = np.unique(every, return_index=True)  # of equal ones that which was counted
    return every, np.concatenate([counts[fresh], np.full(len(hashes), BUCKET + 1)])[first]


def _with_any(nodes: DataFrame, hashes: np.ndarray) -> DataFrame:
    """``sig, k1, k2`` of the nodes with one of ``hashes``, a bounded number, in the prefix."""
    listed = nodes.sparkSession.createDataFrame(pa.table({"h": hashes}))
    # the keys are columns of their own: Spark 4.1 loses the second of two fields of a struct that pass an explode and a join
    return nodes.select("sig", "k1", "k2", F.explode("prefix").alias("h")).join(F.broadcast(listed), "h", "left_semi").select("sig", "k1", "k2").distinct()


def _nodes(rows: DataFrame) -> DataFrame:
    """The distinct sets of ``rows``, which :func:`signed` gave."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "k1", "k2")).alias("first")
    # least of each set: a hot one is one row a task before it moves
    rows = rows.groupBy("sig").agg(least, *[F.first(c).alias(c) for c in ("size", "sketch", "fp", "prefix")])
    return rows.select("sig", "first", "first.k1", "first.k2", "size", "sketch", "fp", "prefix")


def nodes_of(docs: DataFrame) -> DataFrame:
    """The distinct sets of ``docs(doc_id, k1, k2, text)``, ``sig, first, k1, k2, size, sketch, fp, prefix``, under an order in which
    common shingles come last; ``first`` is the least row that has the set, ``k1, k2`` its keys.

    A shingle that becomes common moves back in the order, so only prefixes that hold it change, and only their texts are read again.
    """
    common, often = common_shingles(docs)
    nodes = written(_nodes(signed(docs, common, often)), "nodes")
    while (more := _more_common(nodes, docs, common)) is not None:
        every, counts = np.concatenate([common, more[0]]), np.concatenate([often, more[1]])
        order = np.argsort(every)
        common, often = every[order], counts[order]
        moved = written(_with_any(nodes, more[0]), "moved")
        n, before = moved.count(), nodes
        # rows equal in both keys have one text
        again = _nodes(signed(docs.join(few_or_shuffled(moved.select("k1", "k2"), n), ["k1", "k2"], "left_semi"), common, often))
        nodes = written(before.join(few_or_shuffled(moved.select("sig"), n), "sig", "left_anti").unionByName(again), "nodes")
        removed(before, moved)
    return nodes


def links(nodes: DataFrame, docs: DataFrame, close: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between nodes whose closure is that of all pairs of near copies; ``close`` are the pairs that SimHash proposes."""
    seeds = _verified(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, docs)
    groups = components(seeds)
    group = lambda x, r: groups.select(F.col("a").alias(x), F.col("root").alias(r))
    placed = nodes.select("sig", "size", F.posexplode("prefix").alias("at", "h"))
    shared = placed.groupBy("h").agg(F.min_by("sig", F.struct("at", "sig")).alias("lead"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1"), "shared")
    members = written(unskewed(placed, shared, ["h"], ["sig"]), "members")
    led = members.where("sig != lead").select("sig", "lead").distinct().join(group("sig", "rs"), "sig", "left").join(group("lead", "rl"), "lead", "left")
    led = led.where(F.coalesce("rs", "sig") != F.coalesce("rl", "lead")).select(F.col("sig").alias("a"), F.col("lead").alias("b"))
    star = _verified(led, nodes, docs)
    first = written(seeds.union(star), "first")
    roots = components(first)
    root = lambda x, r: roots.select(F.col("a").alias(x), F.col("root").alias(r))
    leads = shared.join(root("lead", "lead_root"), "lead", "left").select("h", F.coalesce("lead_root", "lead").alias("lead_root"), "n")
    known = unskewed(members.join(root("sig", "root"), "sig", "left"), leads, ["h"], ["sig"]).withColumn("root", F.coalesce("root", "sig"))
    known = written(known, "known")
    # of two members with different roots one at least has another than the lead
    odd = written(known.where("root != lead_root").groupBy("h").agg(F.count("*").alias("n")), "odd")
    # the lead itself was compared with all
    split = unskewed(known.where("sig != lead"), odd, ["h"], ["sig"], counts=shared.select("h", "n")).join(nodes.select("sig", "sketch"), "sig")
    split = written(split.select("h", "sig", "size", "at", "root", "sketch", (F.col("root") != F.col("lead_root")).alias("odd")), "split")
    one = split.where("odd").select("h", *[F.col(c).alias(n) for c, n in (("sig", "x"), ("size", "nx"), ("at", "px"), ("root", "rx"), ("sketch", "sx"))])
    two = split.select("h", *[F.col(c).alias(n) for c, n in (("sig", "y"), ("size", "ny"), ("at", "py"), ("root", "ry"), ("sketch", "sy"))])
    # the first common shingle of a pair that counts passes this, and it lies in both prefixes
    most = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    fits = (F.col("rx") != F.col("ry")) & (5 * F.least("nx", "ny") >= 4 * F.greatest("nx", "ny")) & alike(most, F.col("nx"), F.col("ny"))
    pairs = unskewed(one, two, ["h"], ["x"], counts=odd).where(fits & (9 * _apart(F.col("sx"), F.col("sy")) <= F.col("nx") + F.col("ny")))
    more = _verified(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), nodes, docs)
    out = written(first.union(more), "edges")
    removed(seeds, groups, star, shared, members, first, roots, known, odd, split, more)
    return out
