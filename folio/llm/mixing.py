"""Operator 11: mixing sources to target weights by capped water-filling.

A budget of words is shared among the sources in proportion to their weights. A source gives each document ``epochs`` times at
most; sources whose share is more are clamped there, and what they leave is shared among the others again, until no share is
over its cap. The state of a round is two whole numbers, the words left and the weights that share them: one small aggregation
over the table of sources, whatever its size.

A source then repeats each document a whole number of times, and some once more. Which ones is seeded: documents have an order
by a hash of seed, id and text, and those come once more that lie before the place where the words missing to the target are
reached; the one at that place too, if its middle lies before it. So a source misses its target by half a document at most, a
rerun agrees, and no source is sorted as a whole: words are summed by the first 8 bits of the hash, those of the one range that
holds the place by the next 8, and only the documents of the one range of these are looked at one by one.

Cases: a null text has no words; null is a source of its own, and so is an empty one; a source without words, or without a
positive weight, has target 0; if no source with a weight has words left the budget is not used up; equal rows count each for itself, and if the place falls among them the right
number of them comes once more; documents without words are repeated like others and take nothing; very long texts are whole;
other columns are kept, except those that have the name of a result; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import MOST_HOT, few_or_shuffled, hidden, numbered, removed, table, unskewed, written

EPOCHS, SEED = 3, 42
#: Bits of the hash that orders documents, and those that divide it into ranges, and each range again.
KEY_BITS, RANGE_BITS = 60, 8
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "repeats", "taken")


def _tag(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def order_key(seed: int, doc_id: Column, text: Column) -> Column:
    """The place of a document in its source's seeded order, from 0 to 2**60 - 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, source, text, ...)`` with ``size`` in words and the hidden columns ``_tag`` and ``_key``, under any free names."""
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(*kept, words.alias("size"), _tag(F.col("source")).alias(hidden(docs, "tag")), order_key(seed, F.col("doc_id"), F.col("text")).alias(hidden(docs, "key")))


def water_filled(sources: DataFrame, epochs: int = EPOCHS, budget: int | None = None) -> DataFrame:
    """``sources(source_size, weight, ...)``, a written table of one row each, with ``target``; the budget is all words by default.

    Each round compares in whole numbers whether a source's cap is at most ``weight * left / sharing``.
    """
    cap = F.col("source_size") * epochs
    whole = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(19,0)")
    shares = F.col("weight") > 0
    first = sources.agg(F.sum("source_size"), F.sum(F.when(shares, F.col("weight")))).first()
    budget = int(first[0] or 0) if budget is None else budget
    left, sharing = budget, int(first[1] or 0)
    while sharing:
        clamped = shares & (whole(cap) * whole(sharing) <= whole(left) * whole(F.col("weight")))
        full, rest = sources.agg(F.sum(F.when(clamped, whole(cap))), F.sum(F.when(shares & ~clamped, F.col("weight")))).first()
        state = budget - int(full or 0), int(rest or 0)
        if state == (left, sharing):
            break
        left, sharing = state
    share = F.col("weight").cast("double") * float(left) / float(sharing) if sharing else cap.cast("double")
    target = F.when(~F.coalesce(shares, F.lit(False)), 0.0).otherwise(F.least(cap.cast("double"), share))
    return sources.withColumn("target", target)


def cuts(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """``sources(tag, n, source_size, target)`` with ``whole`` and, where more is wanted, the key ``cut`` up to which the documents
    of ``rows(tag, key, size)`` come once more: those before it, and ``some`` of the ``same`` documents that have it."""
    ratio = F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))
    sources = sources.withColumn("whole", F.coalesce(ratio, F.lit(0)).cast("int"))
    sources = sources.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    wanted = sources.where("missing > 0").select("tag", "missing")
    before = lambda order: F.coalesce(F.sum("size").over(Window.partitionBy("tag").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = lambda bits: F.shiftright("key", KEY_BITS - bits).alias("head")

    def holding(ranges: DataFrame) -> DataFrame:
        """The range of each source in which the missing words are reached; ``base`` are the words before it."""
        met = ranges.withColumn("base", F.col("base") + before("head"))
        return met.where((F.col("base") <= F.col("missing")) & (F.col("base") + F.col("size") > F.col("missing"))).select("tag", "head", "base", "missing")

    coarse = rows.groupBy("tag", head(RANGE_BITS)).agg(F.sum("size").alias("size"))
    coarse = holding(coarse.join(few_or_shuffled(wanted, n_sources), "tag").withColumn("base", F.lit(0).cast("long")))
    inside = rows.select("tag", "key", "size", head(RANGE_BITS)).join(few_or_shuffled(coarse, n_sources), ["tag", "head"]).drop("head")
    fine = inside.groupBy("tag", "base", "missing", head(2 * RANGE_BITS)).agg(F.sum("size").alias("size"))
    fine = holding(fine).select("tag", "head", F.col("base").alias("fine_base"))
    near = inside.select("tag", "key", "size", "missing", head(2 * RANGE_BITS)).join(few_or_shuffled(fine, n_sources), ["tag", "head"]).withColumnRenamed("fine_base", "base")
    alike = near.groupBy("tag", "key", "base", "missing").agg(F.sum("size").alias("size"), F.max("size").alias("one"), F.count("*").alias("same"))
    alike = alike.withColumn("start", F.col("base") + before("key"))
    at = alike.where((F.col("start") <= F.col("missing")) & (F.col("start") + F.col("size") > F.col("missing")))
    some = F.ceil((F.col("missing") - F.col("start")) / F.col("one") + 0.5) - 1
    return sources.join(at.select("tag", F.col("key").alias("cut"), F.least(some, F.col("same")).alias("some"), "same"), "tag", "left").drop("missing", "weight")


def _dealt(rows: DataFrame, plan: DataFrame, n_sources: int, tag: str, key: str) -> DataFrame:
    """``rows`` with the results, by the plan of their source."""
    own = [c for c in rows.columns if c not in (tag, key)]
    of, task, here, place = (hidden(rows, stem) for stem in ("plan", "task", "here", "place"))
    mine = plan.select(F.col("tag").alias(tag), F.struct("source_size", "target", "whole", "cut", "some", "same").alias(of), "n")
    if n_sources <= MOST_HOT:
        joined = rows.join(F.broadcast(mine.drop("n")), tag)
    else:
        joined = unskewed(rows, mine.drop("n").withColumn("n", F.lit(0)), [tag], [key], "n", mine.select(tag, "n"))
    at_cut = F.coalesce(F.col(key) == F.col(of)["cut"], F.lit(False))
    split = at_cut & (F.col(of)["some"] > 0) & (F.col(of)["some"] < F.col(of)["same"])

    def results(frame: DataFrame, more: Column) -> DataFrame:
        repeats = F.col(of)["whole"] + F.coalesce(more, F.lit(False)).cast("int")
        return frame.select(*own, F.col(of)["source_size"].alias("source_size"), F.col(of)["target"].alias("target"), repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))

    plain = (F.col(key) < F.col(of)["cut"]) | (at_cut & (F.col(of)["some"] == F.col(of)["same"]))
    if plan.where("some > 0 and some < same").isEmpty():
        return results(joined, plain)
    # equal documents of which some come once more are numbered: by the task that read them, and within it
    equal = written(joined.where(split).withColumn(task, F.spark_partition_id()), "equal")
    by_task = equal.groupBy(tag, task).agg(F.count("*").alias(here))
    before = F.coalesce(F.sum(here).over(Window.partitionBy(tag).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    equal = equal.withColumn(place, F.row_number().over(Window.partitionBy(tag, task).orderBy(F.lit(0))))
    equal = equal.join(by_task.select(tag, task, before.alias(here)), [tag, task])
    return results(joined.where(~split), plain).unionByName(results(equal, F.col(here) + F.col(place) <= F.col(of)["some"]))


def _mixed(rows: DataFrame, weights: DataFrame | None, epochs: int, budget: int | None) -> DataFrame:
    tag, key = rows.columns[-2:]
    narrow = rows.select(F.col(tag).alias("tag"), F.col(key).alias("key"), "size")
    narrow = narrow if "_written_at" in rows.__dict__ else written(narrow, "sizes")
    sizes = narrow.groupBy("tag").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    if weights is None:
        # by code point, null last: 1, 2, 3 and again
        place = numbered(sizes, "place", (F.col("tag") == "null").asc(), F.col("tag").asc())
        sources = place.withColumn("weight", (F.col("place") % 3 + 1).cast("long")).drop("place")
    else:
        given = weights.groupBy(_tag(F.col("source")).alias("tag")).agg(F.sum("weight").cast("long").alias("weight"))
        sources = sizes.join(given, "tag", "left")
    sources = written(sources, "sources")
    n_sources = sources.count()
    plan = written(cuts(narrow, water_filled(sources, epochs, budget), n_sources), "plan")
    removed(sources)
    return _dealt(rows, plan, n_sources, tag, key)


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: int = EPOCHS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, source, text, ...)`` with ``size``, ``source_size``, ``target``, ``repeats`` and ``taken``.

    ``weights(source, weight)`` are whole numbers, a source without one is left out; by default sources by code point, null last,
    weigh 1, 2, 3 and so on again. ``repeated`` makes the training set of it.
    """
    return _mixed(measured(docs, seed), weights, epochs, budget)


def repeated(mixed: DataFrame) -> DataFrame:
    """A row for each time a document is taken, with ``repetition`` from 1."""
    times = F.when(F.col("repeats") > 0, F.sequence(F.lit(1), F.col("repeats")))
    return mixed.withColumn("repetition", F.explode(times))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(measured(docs).drop("text"), "sizes")
    return _mixed(rows, None, EPOCHS, None).select("doc_id", "size", "source_size", "target", "repeats", "taken")


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS size, 3 * sum(size)::HUGEINT AS cap FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS weight, (sum(size) OVER ())::HUGEINT AS total FROM s
), o AS (
  -- in the order in which a rising level reaches the caps: what is left, and the weights that share it, from each source on
  SELECT *, total - coalesce(sum(cap) OVER up, 0)::HUGEINT AS rest, (sum(weight) OVER (ORDER BY cap / weight, weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS sharing,
    row_number() OVER (ORDER BY cap / weight, weight, source) AS k
  FROM w WINDOW up AS (ORDER BY cap / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, sharing FROM o WHERE cap * sharing > rest * weight ORDER BY k LIMIT 1
), t AS (
  SELECT o.source, o.size, coalesce(least(o.cap::DOUBLE, o.weight::DOUBLE * level.rest::DOUBLE / level.sharing::DOUBLE), o.cap::DOUBLE) AS target FROM o LEFT JOIN level ON true
), p AS (
  SELECT source, size AS source_size, target, CASE WHEN size > 0 THEN floor(target / size)::INT ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, p.source_size::BIGINT AS source_size, target, whole, target - whole * p.source_size::DOUBLE AS missing,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id))::BIGINT AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), r AS (
  SELECT *, whole + (missing > 0 AND (upto <= missing OR upto - size <= missing AND upto - size + size / 2 < missing))::INT AS repeats FROM c
)
SELECT doc_id, size, source_size, target, repeats, size * repeats AS taken FROM r
"""
