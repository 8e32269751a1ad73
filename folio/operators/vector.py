"""Exact vector search, embedding of chunks, and the check of dimensions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.keyword import words
from folio.operators.metadata import restricted
from folio.operators.ranking import effective_k, hydrated, top
from folio.sources.scratch import scratch_folder

#: Queries scored against a chunk batch at once; larger query tables are searched in such blocks.
QUERY_BLOCK = 2048
#: Chunks scored against a block of queries at once, and vectors that place the pivots.
ROW_BLOCK, PIVOT_SAMPLE = 1024, 4096
EMBED_BATCH = 16


class DimensionError(ValueError):
    """Embeddings of several lengths where one is needed."""


def dimensions(chunks: DataFrame, without: DataFrame | None = None) -> list[int]:
    """Distinct lengths of the embeddings, leaving out the documents of ``without``. A handful of numbers."""
    rows = chunks.where("embedding IS NOT NULL")
    if without is not None:
        rows = rows.join(without.select("document_id"), "document_id", "left_anti")
    return sorted(r[0] for r in rows.select(F.size("embedding").alias("d")).distinct().collect())


def check_dimension(chunks: DataFrame, wanted: int | None = None, without: DataFrame | None = None) -> int | None:
    """The one dimension of a knowledge base, None if nothing is embedded."""
    found = dimensions(chunks, without)
    if len(found) > 1 or wanted is not None and found and found[0] != wanted:
        raise DimensionError(f"stored dimensions {found}" + (f", wanted {wanted}" if wanted is not None else ""))
    return found[0] if found else None


def _norms(rows: np.ndarray) -> np.ndarray:
    """Norms of rows, 1 where that is 0: cosines with such a row are 0."""
    norms = np.linalg.norm(rows, axis=1)
    return np.where(norms > 0, norms, 1.0)


def cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of each row with each query in double; 0 where a norm is 0. One matrix of that size is held.

    Sums depend on the shape of what is multiplied: the last digits are rounded away, so that equal vectors are ties.
    """
    a, b = rows.astype("float64"), queries.astype("float64")
    scores = a @ b.T
    scores /= _norms(a)[:, None]
    scores /= _norms(b)[None, :]
    return np.round(scores, 12, out=scores)


def _best(scores: np.ndarray, chunk: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the best ``k`` of a query's candidates, equal ones by chunk."""
    if len(scores) > k:  # keep all ties of the k-th, the order by id is settled below
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((chunk[some], -scores[some]))][:k]


class _Held:
    """Of each query of a block the best ``k`` so far."""

    def __init__(self, n: int, k: int, least: float):
        self._k, self._least = k, least
        self._held = [(np.empty(0), np.empty(0, "int64"), np.empty(0, "int64"))] * n  # score, chunk, document

    def add(self, which: np.ndarray, scores: np.ndarray, chunk: np.ndarray, doc: np.ndarray) -> None:
        """Scores of some rows (down) with the queries ``which`` (across)."""
        for column, q in enumerate(which):
            mine = self._held[q]
            bar = max(self._least, mine[0][-1]) if len(mine[0]) == self._k else self._least
            some = np.flatnonzero(scores[:, column] >= bar)
            if len(some):
                joined = [np.concatenate(x) for x in zip(mine, (scores[some, column], chunk[some], doc[some]), strict=True)]
                keep = _best(*joined, self._k)
                self._held[q] = tuple(x[keep] for x in joined)

    def rows(self, ids: list[int]) -> pa.RecordBatch:
        sizes = [len(h[0]) for h in self._held]
        score, chunk, doc = (np.concatenate([h[i] for h in self._held]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, "int64"), sizes)), pa.array(chunk), pa.array(doc), pa.array(score)], ["query_id", "chunk_id", "document_id", "score"])


FOUND = "query_id long, chunk_id long, document_id long, score double"


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return rows, batch.column("chunk_id").to_numpy(), batch.column("document_id").to_numpy()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROW_BLOCK`` rows, so that their scores with a block of queries take 16 MB."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            yield batch.slice(at, ROW_BLOCK)


def _block_scores(chunks: DataFrame, ids: list[int], matrix: np.ndarray, k: int, least: float) -> DataFrame:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, everyone = _Held(len(ids), k, least), np.arange(len(ids))
        for batch in _slices(batches):
            rows, chunk, doc = _vectors(batch)
            held.add(everyone, cosines(rows, matrix), chunk, doc)
        yield held.rows(ids)

    return chunks.select("chunk_id", "document_id", "embedding").mapInArrow(best, FOUND)


@dataclass(frozen=True)
class StoredVectors:
    """Embeddings in folders by the pivot they are nearest to, and of each pivot the largest angle to one of its vectors.

    The last cluster is that of vectors without a direction.
    """

    vectors: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray

    def reach(self, matrix: np.ndarray) -> np.ndarray:
        """For each query and cluster the largest cosine that a vector of it can have: angles obey the triangle inequality."""
        angle = np.arccos(np.clip(cosines(matrix, self.pivots), -1, 1))
        reach = np.cos(np.clip(angle - self.radius[None, :-1], 0, np.pi)) + 1e-6
        return np.column_stack([reach, np.full(len(matrix), np.inf)])


def _pivots(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Directions that the vectors of a sample gather around: a few rounds of spherical k-means."""
    unit = sample / _norms(sample)[:, None]
    pivots = unit[np.linspace(0, len(unit) - 1, min(clusters, len(unit))).astype(int)]
    for _ in range(8):
        nearest = (unit @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), pivots)
    return pivots


def write_vectors(chunks: DataFrame, folder: str, clusters: int = 64) -> None:
    """Write the embeddings of ``chunks`` below ``folder``, by cluster. A bounded sample places the pivots; it only steers the work."""
    spark, rows = chunks.sparkSession, chunks.where("embedding IS NOT NULL").select("chunk_id", "document_id", "embedding")
    check_dimension(rows)
    share = min(1.0, PIVOT_SAMPLE / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 31)) < int(share * (1 << 31))).select("chunk_id", "embedding").orderBy("chunk_id")
    sample = np.array([r["embedding"] for r in chosen.collect()], "float64")
    pivots = _pivots(sample, clusters) if len(sample) else np.empty((0, 0))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            vectors, _, _ = _vectors(batch)
            directed = np.linalg.norm(vectors.astype("float64"), axis=1) > 0
            cosine = cosines(vectors, pivots) if len(pivots) else np.zeros((len(vectors), 1))
            cluster = np.where(directed & (len(pivots) > 0), cosine.argmax(axis=1), len(pivots))
            angle = np.arccos(np.clip(cosine.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(cluster.astype("int32"))], [*batch.schema.names, "angle", "cluster"])

    schema = "chunk_id long, document_id long, embedding array<float>, angle double, cluster int"
    rows.mapInArrow(placed, schema).hint("rebalance", "cluster").write.partitionBy("cluster").parquet(f"{folder}/vectors")
    written = spark.read.schema(schema).parquet(f"{folder}/vectors")
    # a row a cluster
    about = {r["cluster"]: (r["radius"], r["n"]) for r in written.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    lines = [(k, p.tolist(), *about.get(k, (0.0, 0))) for k, p in enumerate(pivots)] + [(len(pivots), [], np.pi, about.get(len(pivots), (0.0, 0))[1])]
    spark.createDataFrame(lines, "cluster int, pivot array<double>, radius double, n long").coalesce(1).write.parquet(f"{folder}/pivots")


def read_vectors(spark: SparkSession, folder: str) -> StoredVectors:
    lines = spark.read.schema("cluster int, pivot array<double>, radius double, n long").parquet(f"{folder}/pivots").orderBy("cluster").collect()
    pivots = np.array([r["pivot"] for r in lines[:-1]], "float64")
    rows = spark.read.schema("chunk_id long, document_id long, embedding array<float>, cluster int").parquet(f"{folder}/vectors")
    return StoredVectors(rows, pivots, np.array([r["radius"] for r in lines]), np.array([r["n"] for r in lines]))


def _cluster_scores(vectors: DataFrame, visits: np.ndarray, ids: list[int], matrix: np.ndarray, k: int, least: float) -> DataFrame:
    """The best of the clusters that each query visits (``visits``: queries down, clusters across); no other folder is read."""
    of = {int(c): np.flatnonzero(visits[:, c]) for c in np.flatnonzero(visits.any(axis=0))}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(len(ids), k, least)
        for batch in _slices(batches):
            rows, chunk, doc = _vectors(batch)
            cluster = batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                here = cluster == c
                held.add(of[int(c)], cosines(rows[here], matrix[of[int(c)]]), chunk[here], doc[here])
        yield held.rows(ids)

    return vectors.where(F.col("cluster").isin(sorted(of))).select("chunk_id", "document_id", "embedding", "cluster").mapInArrow(best, FOUND)


def first_visits(stored: StoredVectors, reach: np.ndarray, k: int) -> np.ndarray:
    """The clusters that reach highest for each query, until they have ``k`` vectors."""
    order = np.argsort(-reach[:, :-1], axis=1, kind="stable")
    before = np.cumsum(stored.sizes[:-1][order], axis=1) - stored.sizes[:-1][order]
    visits = np.zeros(reach.shape, bool)
    np.put_along_axis(visits, order, before < k, axis=1)
    return visits


def pruned_ranks(stored: StoredVectors, queries: DataFrame, k: int, min_score: float = 0.0, metadata: DataFrame | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """What :func:`vector_ranks` gives, exactly, from stored vectors.

    Each query first visits the clusters that reach highest; its k-th score there then rules out all clusters that do not
    reach it. Queries come to the driver a block at a time, and a block's result is written before the next.
    """
    spark, candidates = stored.vectors.sparkSession, restricted(stored.vectors, metadata, filters)
    lengths = {r[0] for r in queries.where("vec IS NOT NULL").select(F.size("vec")).distinct().collect()}
    if len(stored.pivots) and lengths - {stored.pivots.shape[1]}:
        raise DimensionError(f"stored dimension {stored.pivots.shape[1]}, query dimensions {sorted(lengths)}")
    folder = scratch_folder(spark, "ranks")
    top(spark.createDataFrame([], FOUND), k).write.parquet(folder)
    rows = ((r["query_id"], r["vec"]) for r in queries.where("vec IS NOT NULL").select("query_id", "vec").toLocalIterator())
    while block := list(islice(rows, QUERY_BLOCK)):
        if not stored.sizes.sum():
            break
        ids, matrix = [i for i, _ in block], np.array([v for _, v in block], "float32")
        reach = stored.reach(matrix) if len(stored.pivots) else np.full((len(ids), 1), np.inf)
        visits = first_visits(stored, reach, k)
        found = top(_cluster_scores(candidates, visits, ids, matrix, k, min_score), k)
        place = scratch_folder(spark, "first")
        found.write.parquet(place)
        found = spark.read.schema(found.schema).parquet(place)
        # a number a query of the block
        least = dict.fromkeys(ids, min_score) | {r["query_id"]: r["score"] for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}
        more = (reach >= np.array([least[i] for i in ids])[:, None]) & ~visits
        both = found.drop("rank").select("query_id", "chunk_id", "document_id", "score").unionByName(_cluster_scores(candidates, more, ids, matrix, k, min_score))
        top(both, k).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def vector_ranks(chunks: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0, metadata: DataFrame | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """``query_id, rank, chunk_id, document_id, score`` for ``queries(query_id, vec)``; null vectors find nothing.

    Chunks stay where they are: each task scores its batches against a block of queries and passes on its best ``k``. With more
    queries than one block holds, each block's result is written before the next block comes to the driver.
    """
    candidates = restricted(chunks.where("embedding IS NOT NULL"), metadata, filters)
    queries = queries.where("vec IS NOT NULL")
    lengths = {r[0] for r in queries.select(F.size("vec")).distinct().collect()}
    stored = dimensions(candidates)
    if stored and lengths and (len(stored) > 1 or len(lengths) > 1 or stored != sorted(lengths)):
        raise DimensionError(f"stored dimensions {stored}, query dimensions {sorted(lengths)}")
    empty = candidates.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", "document_id", F.lit(0.0).alias("score")).where("false")
    rows = ((r["query_id"], r["vec"]) for r in queries.select("query_id", "vec").toLocalIterator())
    block = list(islice(rows, QUERY_BLOCK))
    scored = lambda b: top(_block_scores(candidates, [i for i, _ in b], np.array([v for _, v in b], "float32"), k, min_score), k)
    if not block:
        return top(empty, k)
    first, block = block, list(islice(rows, QUERY_BLOCK))
    if not block:
        return scored(first)
    # what makes the candidates is done once, not for each block
    place = scratch_folder(candidates.sparkSession, "candidates")
    candidates.select("chunk_id", "document_id", "embedding").write.parquet(place)
    candidates = candidates.sparkSession.read.parquet(place)
    folder = scratch_folder(candidates.sparkSession, "ranks")
    scored(first).write.parquet(folder)
    while block:
        scored(block).write.mode("append").parquet(folder)
        block = list(islice(rows, QUERY_BLOCK))
    return candidates.sparkSession.read.parquet(folder)


def vector_search(chunks: DataFrame, documents: DataFrame, queries: DataFrame, top_k: int = 5, min_score: float = 0.0, metadata: DataFrame | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """The ``top_k`` chunks of each query by cosine, none under ``min_score`` (0 by default: negative cosines go)."""
    k = effective_k(top_k)
    return hydrated(vector_ranks(chunks, queries, k, min_score, metadata, filters), chunks, documents, "vector", k * queries.count())


def hashed_embedder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder that needs no model: signed feature hashing of words, L2-normalised.

    Where the signs of all words cancel out, the word of the least hash counts alone: only texts without words have no direction.
    """

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), "float32")
        for i, text in enumerate(texts):
            least = None
            for word in words(text):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1 if h >> 63 else -1
                least = h if least is None else min(h, least)
            if least is not None and not out[i].any():
                out[i, least % dimension] = 1 if least >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    return embed


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = EMBED_BATCH) -> DataFrame:
    """``chunks`` with ``embedding`` from ``embed`` and ``error`` (null if all went well).

    Texts go to ``embed`` in their order, ``batch`` at a time. A wrong number of vectors, or an exception, is an error of
    the rows of that batch; what it means for their documents is the caller's to decide.
    """
    plain = chunks.drop("embedding", "error")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", embedding array<float>, error string"

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            vectors: list[list[float] | None] = []
            errors: list[str | None] = []
            for at in range(0, len(texts), batch):
                part = [t or "" for t in texts[at : at + batch]]
                try:
                    got = embed(part)
                    problem = None if len(got) == len(part) else f"embedder gave {len(got)} vectors for {len(part)} texts"
                except Exception as e:  # noqa: BLE001  an embedder's failure is a row's error, not the job's
                    got, problem = [], f"{type(e).__name__}: {e}"
                vectors += [None] * len(part) if problem else [np.asarray(v, "float32").tolist() for v in got]
                errors += [problem] * len(part)
            arrays = [*rows.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*rows.schema.names, "embedding", "error"])

    return plain.mapInArrow(embedded, schema)
