"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import removed, written


def _tighter(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round. Minima are aggregated before each join, so a hub is no hot group."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    # large star: each larger neighbour of a is tied to the least of a's neighbourhood
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    # small star: a and its smaller neighbours are tied to the least of them
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    tied = large.join(least, "a")
    return tied.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(a, root)``: for every node of ``edges(a long, b long)`` that is not itself a root, its component's least node.

    Each round's edges are written to the shared folder, so a lost executor repeats one round at most; those of the round
    before are then removed. What is returned is such a table.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state or found[0] == 0:
            out = now.select("a", F.col("b").alias("root"))
            out.__dict__["_written_at"] = now.__dict__["_written_at"]
            return out
        state, before = found, now
        now = written(_tighter(before), "edges")
        removed(before)
    raise RuntimeError("the components did not settle")
