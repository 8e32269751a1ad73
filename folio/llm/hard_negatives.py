"""Operator 12: hard negatives by the threshold algorithm.

A row's score is the inner product of its whole-number vector with the anchor's. For the threshold algorithm each dimension has
a list of the candidates sorted by their component. An anchor reads all lists at once, from the top where its own component is
positive and from the bottom where it is negative; a candidate that turns up for the first time is scored whole, by random access.
No candidate that has not turned up can score more than the threshold, the sum over the dimensions of the anchor's component
times the last one read. An anchor is done as soon as the threshold lies strictly below the k-th score of each of its windows, or
below the window itself, so that equal scores are still seen and go by vec_id. A window is a range of scores, the label that
counts, and the ``k`` best in it: positives have one of all scores and the anchor's own label; negatives have one for each
positive, from 0.8 of its score up to it, and other labels.

Anchors and candidates meet in a grid of cells, ``ANCHORS`` by ``CANDIDATES`` rows at most in the mean; a cell keeps its best k of each window,
and the best of all cells are taken by a window function that prunes before it shuffles. So what one task holds is bounded, and
the work is that of the stated anchors against all rows.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors meet those of their
length only, and empty ones score 0; rows of one vec_id are rows of their own, each an anchor or candidate, but no row is its
own positive; a null vec_id is no anchor and comes last among equal scores; components are long numbers, and so are scores: what is larger counts as
the largest; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import removed, table, written

POSITIVES, NEGATIVES = 5, 5
#: Mean rows of a cell on either side.
ANCHORS, CANDIDATES = 1024, 4096
#: Places of each list that are read at a time, at first; each turn reads twice as many.
STEP = 4
LONG = 1 << 63


def whole_vectors(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``vec array<long>`` of the rows of ``rows(label, embedding, ...)`` that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: finite(x.cast("double")))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256.0).cast("long"))
    return rows.where(F.coalesce(fit, F.lit(False))).select(*keep, vec.alias("vec"))


def _matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """A number type in which inner products of rows of ``a`` and ``b`` are exact, and so are all partial sums."""
    most = lambda m: max(1, int(m.max(initial=0)), -int(m.min(initial=0)))
    return np.float64 if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53 else object


def _limited(scores: object) -> object:
    """Scores within the limits of a long; those of floats are."""
    if isinstance(scores, int):
        return max(-LONG, min(LONG - 1, scores))
    return np.clip(scores, -LONG, LONG - 1) if scores.dtype == object else scores


class Lists:
    """The candidates of a cell: their vectors and, for each dimension, their numbers by rising component."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.rows = vectors, len(vectors)
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(vectors, self.order.T, axis=0).T

    def search(self, anchor: np.ndarray, fits: np.ndarray, low: list[int], high: list[int], ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each window ``[low, high]`` the numbers and scores of the best ``k`` candidates that ``fits`` allows."""
        used = np.flatnonzero(anchor != 0)
        seen = np.zeros(self.rows, bool)
        score = np.zeros(self.rows, self.vectors.dtype)
        if not len(used):  # all score 0
            seen[:] = True
        signed, up = anchor[used], (anchor[used] > 0)
        at, step = 0, STEP
        while not seen.all():
            to = min(self.rows, at + step)
            # a list is read from its end where the component is positive
            turned = [self.order[d, self.rows - to : self.rows - at] if p else self.order[d, at:to] for d, p in zip(used, up, strict=True)]
            new = np.unique(np.concatenate(turned))
            new = new[~seen[new]]
            score[new] = _limited(self.vectors[new] @ anchor)
            seen[new] = True
            last = np.array([self.sorted[d, self.rows - to] if p else self.sorted[d, to - 1] for d, p in zip(used, up, strict=True)], self.vectors.dtype)
            threshold = _limited((signed * last).sum())
            at, step = to, step * 2
            if all(threshold < max(lo, self._kth(score, seen & fits, lo, hi, k)) for lo, hi in zip(low, high, strict=True)):
                break
        out = []
        for lo, hi in zip(low, high, strict=True):
            found = np.flatnonzero(seen & fits & (score >= lo) & (score <= hi))
            best = found[np.lexsort((ids[found], -score[found]))][:k]
            out.append((best, score[best]))
        return out

    @staticmethod
    def _kth(score: np.ndarray, among: np.ndarray, low: int, high: int, k: int) -> float:
        found = score[among & (score >= low) & (score <= high)]
        return np.partition(found, len(found) - k)[len(found) - k] if len(found) >= k else -np.inf


def _cell(windows: Callable[[dict, int], tuple[list[int], list[int], list[object]]], same_label: bool, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Search of one cell: ``(row, of, found, vec_id, score)``, the best of each window of each anchor."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: dict[str, list] = {"row": [], "of": [], "found": [], "vec_id": [], "score": []}
        if anchors.num_rows and candidates.num_rows:
            a = _matrix(anchors.column("vec").combine_chunks(), anchors.num_rows)
            c = _matrix(candidates.column("vec").combine_chunks(), candidates.num_rows)
            kind = _exact(a, c)
            a, c = a.astype(kind), c.astype(kind)
            label, mine = (t.column("label").to_numpy() for t in (candidates, anchors))
            row, own = (t.column("row").to_numpy() for t in (candidates, anchors))
            vec_id = candidates.column("vec_id").to_pylist()
            ids = np.array([LONG if v is None else v for v in vec_id], object) if None in vec_id else np.array(vec_id, "int64")
            ids = np.argsort(np.argsort(ids, kind="stable"), kind="stable") if ids.dtype == object else ids
            details = {name: anchors.column(name).to_pylist() for name in anchors.column_names if name not in ("vec", "label", "row", "vec_id")}
            everything = None if same_label else Lists(c)
            of_label: dict[int, tuple[np.ndarray, Lists]] = {}
            for i in range(len(a)):
                if same_label:  # the lists of the rows of one label, made when the first anchor asks for them
                    if mine[i] not in of_label:
                        members = np.flatnonzero(label == mine[i])
                        of_label[mine[i]] = members, Lists(c[members])
                    members, lists = of_label[mine[i]]
                    fits = row[members] != own[i]
                else:
                    members, lists, fits = slice(None), everything, label != mine[i]
                low, high, of = windows(details, i)
                if not lists.rows or not low:
                    continue
                numbers = np.arange(len(c))[members]
                for what, (best, score) in zip(of, lists.search(a[i], fits, low, high, ids[members], k), strict=True):
                    for j, s in zip(best, score, strict=True):
                        out["row"].append(own[i])
                        out["of"].append(what)
                        out["found"].append(row[numbers[j]])
                        out["vec_id"].append(vec_id[numbers[j]])
                        out["score"].append(int(s))
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def _grid(anchors: DataFrame, rows: DataFrame, windows: Callable, same_label: bool, k: int, cells: tuple[int, int]) -> DataFrame:
    """The best ``k`` of each window over all cells: ``row, of, rank, vec_id, score, found``."""
    down, across = cells
    where = lambda frame, n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    # vectors of one length meet
    a = anchors.withColumn("length", F.size("vec")).withColumn("a", where(anchors, down)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    c = rows.withColumn("length", F.size("vec")).withColumn("c", where(rows, across)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    drop = lambda f: lambda left, right: f(left.drop_columns(["length", "a", "c"]), right.drop_columns(["length", "a", "c"]))
    keys = ["a", "c", "length"]
    found = a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(drop(_cell(windows, same_label, k)), "row long, of long, found long, vec_id long, score long")
    order = Window.partitionBy("row", "of").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _everything(details: dict, i: int) -> tuple[list[int], list[int], list[int]]:
    return [-(1 << 200)], [1 << 200], [0]


def _below_positives(details: dict, i: int) -> tuple[list[int], list[int], list[int]]:
    """For each positive the whole scores from 0.8 of its own up to it; a negative score has none."""
    low, high, of = [], [], []
    for number, score in zip(details["numbers"][i], details["scores"][i], strict=True):
        if score >= 0:
            low.append(-(-80 * score // 100))
            high.append(score)
            of.append(number)
    return low, high, of


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows(vec_id, label, embedding)``.

    ``anchor`` says which rows are anchors; every row that takes part is a candidate.
    """
    fit = whole_vectors(rows, ["vec_id", F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")])
    fit = written(fit.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_anchors, n = fit.agg(F.count_if("is_anchor"), F.count("*")).first()
    cells = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n // CANDIDATES))
    everyone = fit.drop("is_anchor")
    # names of its own: both sides of the grid come from one table
    mine = fit.where("is_anchor").select(*[F.col(c).alias(c) for c in everyone.columns])
    best = written(_grid(mine, everyone, _everything, True, positives, cells), "positives")
    # at most ``positives`` rows an anchor
    asked = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    asked = mine.join(asked, "row").select("*", F.col("p.rank").cast("array<long>").alias("numbers"), F.col("p.score").alias("scores")).drop("p")
    found = _grid(asked, everyone, _below_positives, False, negatives, cells)
    pairs = best.select("row", F.col("rank").cast("long").alias("of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(mine.select("row", F.col("vec_id").alias("anchor_id")), "row")
    found = found.select("row", "of", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(found, ["row", "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    out = written(out, "negatives")
    removed(fit, best)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", wrong), F.col("vec_id") % 100 == 0)


OP12_SQL = r"""
WITH r AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS a, c.row AS c, a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS alike, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.row <> c.row
), p AS (
  SELECT a, c, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id))::INT AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
