"""Operator 4: line dedup by winnowing, in DataFrame functions only.

Lines with words are the units; their places are counted in words. A gram is the shortest run of lines from a line on that
has ``GRAM_WORDS`` words. In every window of ``RUN_WORDS`` words the gram with the least hash is a fingerprint, so two equal
runs of that many words always share one. A fingerprint is keyed once for each line it may be the fingerprint of: by the
shortest run of lines from that line on that has ``RUN_WORDS`` words (which holds the whole gram), and by its place there. Each
key is joined to its first occurrence in the corpus (least doc_id, then place), never to all others; as every repeated run is
covered by such shortest runs, each is found wherever its grams stand else. The match is extended line by line both ways,
extensions on one diagonal are merged to runs, and later runs of ``RUN_WORDS`` words or more are deleted. The first occurrence
of every line always stays.

Cases: a null text counts as empty; texts without repeated runs stay as they are, to the character; a text that repeats
earlier ones throughout becomes empty; rows equal in doc_id and text are one document and none is deleted for the other; rows
equal only in doc_id are ordered by a hash of their text; null doc_ids come first; blank lines inside a deleted run go with it;
other columns are kept whatever their names, except those that have the name of a result; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import removed, table, unskewed, very_frequent, written

GRAM_WORDS, RUN_WORDS = 20, 50
WORD = r"[^\x20\x09-\x0D]+"


def _lines(keyed: DataFrame) -> DataFrame:
    """``k0, k1, k2, p, line, s, e, total``: each line with words, its place and the words before and up to its end."""
    rows = keyed.select("k0", "k1", "k2", F.posexplode(F.split("whole", "\n", -1)).alias("p", "x"))
    rows = rows.select("k0", "k1", "k2", "p", F.xxhash64("x").alias("line"), F.regexp_count("x", F.lit(WORD)).alias("n")).where("n > 0")
    once = rows.repartition("k1", "k2").dropDuplicates(["k1", "k2", "p"])  # repeated rows; the shuffle serves the windows too
    doc = Window.partitionBy("k1", "k2")
    e = F.sum("n").over(doc.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("e", e).withColumn("s", F.col("e") - F.col("n")).withColumn("total", F.max("e").over(doc))


def _fingerprints(lines: DataFrame, gram_words: int, run_words: int) -> DataFrame:
    """The winnowed fingerprints, with the lines around them: ``before`` from near to far, ``after`` from the gram's first on."""
    by_word = Window.partitionBy("k1", "k2").orderBy("s")
    ahead = lambda a, z: by_word.rangeBetween(a, z)
    gram = F.when(F.col("total") - F.col("s") >= gram_words, F.xxhash64(F.collect_list("line").over(ahead(0, gram_words - 1))))
    whole = F.col("total") - F.col("s") >= run_words
    # grams that start up to here end inside the window
    least = F.min(F.struct("gram", "s")).over(ahead(0, run_words - gram_words))
    grams = lines.withColumn("gram", gram).withColumn("least", F.when(whole, least))
    # a line is chosen if a window that starts at it or at most run_words - gram_words before it has its gram as the least
    chosen = F.array_contains(F.collect_set("least.s").over(ahead(gram_words - run_words, 0)), F.col("s"))
    near = grams.select(
        "*",
        chosen.alias("chosen"),
        F.reverse(F.collect_list(F.struct("line", "s", "p")).over(ahead(-run_words, -1))).alias("before"),
        F.collect_list(F.struct("line", "e", "p")).over(ahead(0, run_words - 1)).alias("window"),
    )
    # the line itself may be long: what follows is counted from the next line on
    follows = F.coalesce(F.lead("window").over(by_word), F.array().cast(near.schema["window"].dataType))
    near = near.withColumn("after", F.concat(F.array(F.struct("line", "e", "p")), follows))
    return near.where("chosen").select("k0", "k1", "k2", "s", "p", "gram", "before", "after")


def _common(a: Column, b: Column) -> Column:
    """How many first elements of two arrays of lines are equal."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, i)["line"] != F.get(b, i)["line"])
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)), n))


def _run_keys(gram_words: int, run_words: int) -> Column:
    """For each line a window with this gram may start at: a hash of its shortest run of ``run_words`` words; null past the end."""
    near = F.filter("before", lambda x: x["s"] >= F.col("s") - (run_words - gram_words))
    hashes = lambda rows: F.transform(rows, lambda x: x["line"])

    def key(i: Column) -> Column:
        end = F.coalesce(F.get("before", i - 1)["s"], F.col("s")) + run_words
        n = F.size(F.filter("after", lambda x: x["e"] < end)) + 1
        return F.when(n <= F.size("after"), F.xxhash64(i, F.col("gram"), hashes(F.slice("before", 1, i)), hashes(F.slice("after", 1, n))))

    return F.transform(F.sequence(F.lit(0), F.size(near)), key)


def repeated_runs(keyed: DataFrame, gram_words: int, run_words: int) -> DataFrame:
    """``k1, k2, runs``: for each document with later repeated runs, their first and last lines.

    Every lookup is of rows by a key that may be that of a third of them, so all go through :func:`unskewed`.
    """
    place, first = ["k1", "k2", "s"], ["c1", "c2", "c"]
    prints = written(_fingerprints(_lines(keyed), gram_words, run_words), "prints")
    often = written(prints.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    again = written(unskewed(prints, often, ["gram"], place), "again")
    places = again.select("k0", *place, F.explode(_run_keys(gram_words, run_words)).alias("key")).where("key is not null")
    places = written(places, "places")
    origin = places.groupBy("key").agg(F.min(F.struct("k0", *place)).alias("first"), F.count("*").alias("n")).where("n > 1")
    origin = written(origin.select("key", *[F.col(f"first.{x}").alias(y) for x, y in zip(place, first, strict=True)], "n"), "origins")
    pairs = unskewed(places, origin, ["key"], place).where("k1 != c1 OR k2 != c2 OR s != c")
    pairs = written(pairs.select(*place, *first).distinct(), "pairs")
    own = again.select(*place, "p", "before", "after")
    theirs = again.select(*[F.col(x).alias(y) for x, y in zip(place, first, strict=True)], F.col("before").alias("before2"), F.col("after").alias("after2"))
    theirs = written(theirs.join(pairs.groupBy(*first).agg(F.count("*").alias("n")), first), "firsts")
    met = unskewed(pairs.join(own, place), theirs, first, place)
    met = met.withColumn("back", _common(F.col("before"), F.col("before2"))).withColumn("on", _common(F.col("after"), F.col("after2"))).where("on > 0")
    start, stop = F.get("before", F.col("back") - 1), F.get("after", F.col("on") - 1)
    spans = met.select(
        "k1",
        "k2",
        F.struct("c1", "c2", (F.col("s") - F.col("c")).alias("shift")).alias("diagonal"),
        F.when(F.col("back") == 0, F.col("s")).otherwise(start["s"]).alias("s"),
        F.when(F.col("back") == 0, F.col("p")).otherwise(start["p"]).alias("p"),
        stop["e"].alias("e"),
        stop["p"].alias("q"),
    )
    line_up = Window.partitionBy("k1", "k2", "diagonal").orderBy("s", "e")
    reached = F.max("e").over(line_up.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("s") <= reached, 0).otherwise(1))
    spans = spans.withColumn("run", F.sum("new").over(line_up.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("k1", "k2", "diagonal", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("p").alias("p"), F.max("q").alias("q"))
    runs = runs.where(F.col("e") - F.col("s") >= run_words).groupBy("k1", "k2").agg(F.collect_set(F.struct("p", "q")).alias("runs"))
    runs = written(runs, "runs")
    removed(prints, often, again, places, origin, pairs, theirs)
    return runs


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``, and ``n_lines``, ``n_deleted`` (lines before, lines cut)."""
    text = F.coalesce("text", F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"),  # whatever their names are, they clash with none below
        text.alias("whole"),
        F.col("doc_id").alias("k0"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), text).alias("k2"),
    )
    keys = ["k1", "k2"]
    hot = very_frequent(keyed.select(*keys), keys)
    narrow = keyed.select("k0", *keys, "whole")
    if hot is not None:  # of a million equal rows one is taken apart
        narrow = narrow.join(hot, keys, "left_anti").unionByName(narrow.join(hot, keys, "left_semi").dropDuplicates(keys))
    runs = repeated_runs(narrow, gram_words, run_words)
    # the runs grow with the corpus: never a broadcast, whatever their size now
    if hot is None:
        joined = keyed.join(runs.hint("merge"), keys, "left")
    else:
        joined = keyed.join(hot, keys, "left_anti").join(runs.hint("merge"), keys, "left")
        joined = joined.unionByName(keyed.join(hot, keys, "left_semi").join(F.broadcast(runs.join(hot, keys, "left_semi")), keys, "left"))
    cut = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["p"], r["q"]))))
    joined = joined.withColumn("cut", F.when(F.col("runs").isNotNull(), cut))
    lines = F.split("whole", "\n", -1)
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "cut"), lambda i: F.get(lines, i))
    joined = joined.withColumn("size", F.size(lines).cast("long"))
    changed = F.when(F.col("runs").isNull(), F.col("own.text")).otherwise(F.array_join(rest, "\n"))
    own = [changed.alias("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in kept]
    return joined.select(*own, F.col("size").alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_deleted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")
