"""Operator 13: groups of spelling variants, by a dictionary of pairs of trie nodes.

The distinct words, forward and reversed, make two tries, whose nodes are numbered. A place of a word is then a pair of whole
numbers: the node of what stands before it and the node, of the reversed trie, of what stands after it. A word has a pair for
each code point that it skips, and one for each gap between code points. Words that skip one code point to the same pair differ
in just that code point; a word that skips to the pair of another's gap has one code point more. So one grouping of the pairs
finds all words one insertion, deletion or replacement apart, exactly and nothing else: no distance is computed. A code point among equal ones is skipped for the
longer word only once, at the last of them, so that each two words meet once. The words of a group differ in one code point of an alphabet of 90
letters, so a group has 91 at most, whatever the data.

Nodes are numbered by a scan of the words in order, range by range: a word shares with the word before it the nodes of their
common beginning and has new ones after it. The nodes of the last word of a range go on in the next; they are numbered by
range and depth, so only the first and last word of each range need to be known before the ranges are scanned at once.
The work is linear in the length of the words.

Cases: a null text has no words; a null doc_id is hashed as the empty string; documents count as often as they stand there, ties of counts are broken by code
points; very long texts are read whole, piece by piece, and so are very long words; only doc_id and text are read; an empty
table, or one without words that are long and frequent enough, gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import removed, table, unskewed, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LENGTH, TIMES, TYPOS = 5, 3, 97
#: Different words a task counts before it passes them on.
COUNTED = 200_000
#: Bits of a node's number within its range.
LOCAL_BITS = 40


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, A-Z lowered, some at a time."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: lowers A-Z only
    if len(text) < 1 << 20:
        yield RUN.findall(text)
        return
    some = []
    for match in RUN.finditer(text):
        some.append(match[0])
        if len(some) == 1 << 16:
            yield some
            some = []
    yield some


def counted_words(docs: DataFrame, length: int = LENGTH, times: int = TIMES, typos: int | None = TYPOS) -> DataFrame:
    """``word, n`` of ``docs(doc_id, text)``: the words of at least ``length`` code points that occur ``times`` times or more.

    With ``typos`` the runs whose hash with the document's id it divides lose a code point first.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = [(w, n) for w, n in found.items() if len(w) >= length]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = crc32(b"" if doc_id is None else b"%d" % doc_id)
                start = crc32(b":", start)
                for runs in _runs(text.as_py() or ""):
                    here = Counter(runs)
                    for run, n in here.items() if typos else ():
                        h = crc32(run.encode(), start)
                        if h % typos == 0:
                            at = h % len(run)
                            found[run[:at] + run[at + 1 :]] += n
                            here[run] = 0
                    found.update(here)
                if len(found) >= COUNTED:
                    yield out()
        yield out()

    words = docs.select("doc_id", "text").mapInArrow(counts, "word string, n long").where("n > 0")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # equal up to low, different within n
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def numbered_nodes(words: DataFrame, name: str) -> DataFrame:
    """``word, n, id, nodes`` of distinct ``words(word, n)``: the numbers of the trie nodes of its beginnings, the empty one first,
    and a number of the word itself; these rise with the code points. ``name`` tells the written table from others."""
    ranges = written(words.repartitionByRange("word").withColumn("range", F.spark_partition_id()), f"words-{name}")
    # a row a range
    ends = {r["range"]: (r["first"], r["last"]) for r in ranges.groupBy("range").agg(F.min("word").alias("first"), F.max("word").alias("last")).collect()}
    # for each range the one before it, and how much of that one's last word its first word begins with
    order = sorted(ends)
    before = {b: (a, ends[a][1], _shared(ends[a][1], ends[b][0])) for a, b in zip(order, order[1:], strict=False)}

    def inherited(r: int) -> tuple[str, list[int]]:
        """The word before the range, and the numbers of those of its nodes that go on in the range; all others are new."""
        if r not in before:
            return "", [0]
        depth, nodes = before[r][2], []
        word, at = before[r][1], before[r][0]
        # a node of the last word of a range is numbered there, or goes on from the range before if all its words begin with it
        while depth > 0 and at in before and (common := min(before[at][2], _shared(*ends[at]))) > 0:
            nodes[:0] = [(at + 1 << LOCAL_BITS) + d for d in range(common + 1, depth + 1)]
            depth, at = min(depth, common), before[at][0]
        nodes[:0] = [(at + 1 << LOCAL_BITS) + d for d in range(1, depth + 1)]
        return word, [0, *nodes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, nodes, fresh, place = None, "", [0], 0, 0
        for batch in batches:
            numbers, ids, ends_at, flat = batch.column("range").to_pylist(), [], [0], []
            for r, word in zip(numbers, batch.column("word").to_pylist(), strict=True):
                if r != now:
                    now, place = r, 0
                    last, nodes = inherited(r)
                    final = ends[r][1]
                    fresh = len(final) + 1
                # nodes that are passed on hold for the first word alone; from it on they are those of the word before
                common = min(_shared(last, word), len(nodes) - 1)
                on_final = _shared(final, word)
                nodes = nodes[: common + 1]
                for d in range(common + 1, len(word) + 1):
                    if d <= on_final:  # a node of the range's last word
                        nodes.append((r + 1 << LOCAL_BITS) + d)
                    else:
                        nodes.append((r + 1 << LOCAL_BITS) + fresh)
                        fresh += 1
                last, place = word, place + 1
                ids.append((r << LOCAL_BITS) + place)
                flat.append(np.array(nodes, "int64"))
                ends_at.append(ends_at[-1] + len(nodes))
            values = np.concatenate(flat) if flat else np.empty(0, "int64")
            lists = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.int64()), lists], ["word", "n", "id", "nodes"])

    sorted_ranges = ranges.repartition("range").sortWithinPartitions("range", "word")
    out = written(sorted_ranges.mapInArrow(scan, "word string, n long, id long, nodes array<long>"), f"nodes-{name}")
    removed(ranges)
    return out


def near_words(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """``id, near, near_n`` for each word and each word one insertion, deletion or replacement apart; ids are of ``forward``."""
    back = backward.select(F.reverse("word").alias("word"), F.col("nodes").alias("ends"))
    words = forward.join(back, "word").withColumn("size", F.char_length("word"))
    code = lambda i: F.substring("word", i + 1, F.lit(1))
    pair = lambda i, skip, kind: F.struct(F.get("nodes", i).alias("head"), F.get("ends", F.col("size") - i - skip).alias("tail"), kind.alias("kind"))
    every = lambda last, f: F.transform(F.sequence(F.lit(0), last), f)
    # kinds: 0 a gap, 1 a skipped code point, 2 one that is the last of equal ones
    skips = every(F.col("size") - 1, lambda i: pair(i, 1, F.when(code(i) == code(i + 1), 1).otherwise(2)))
    gaps = every(F.col("size"), lambda i: pair(i, 0, F.lit(0)))
    rows = words.select("id", "n", F.explode(F.concat(skips, gaps)).alias("p"))
    group = rows.groupBy("p.head", "p.tail").agg(F.collect_list(F.struct("id", "n", "p.kind")).alias("words")).where("size(words) > 1")
    one = group.select("words", F.explode("words").alias("w"))
    met = one.select("w", F.explode("words").alias("v")).where("w.id != v.id")
    # two that skip, or one that skips the last of equal ones and one with the gap
    near = ((F.col("w.kind") > 0) & (F.col("v.kind") > 0)) | (F.col("w.kind") + F.col("v.kind") == 2)
    return met.where(near).select("w.id", F.col("v.id").alias("near"), F.col("v.n").alias("near_n"))


def spelling_groups(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct ``words(word, n)``.

    A word's form is its most frequent near word (of those the first in code-point order), if that is at least twice as
    frequent; the root is the last form of forms.
    """
    words = written(words, "vocabulary")
    forward = numbered_nodes(words, "forward")
    backward = numbered_nodes(words.select(F.reverse("word").alias("word"), "n"), "backward")
    near = near_words(forward, backward)
    # the most frequent, and of equal ones the first: ids rise with code points
    best = F.max(F.struct("near_n", (-F.col("near")).alias("first"))).alias("best")
    near = near.groupBy("id").agg(F.count("*").alias("n_near"), best)
    near = written(near.select("id", "n_near", (-F.col("best.first")).alias("form_id"), F.col("best.near_n").alias("form_n")), "near")
    named = forward.select("id", "word", "n")
    forms = named.select("id", "n").join(near, "id").where(F.col("form_n") >= 2 * F.col("n")).select("id", "form_id", "form_n")
    forms = written(forms.join(named.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id"), "forms")
    ends = _last(forms.select("id", F.col("form_id").alias("to")))
    # any number of words may have one root
    roots = ends.groupBy("to").agg(F.count("*").alias("n")).join(named.select(F.col("id").alias("to"), F.col("word").alias("root")), "to")
    roots = unskewed(ends, roots, ["to"], ["id"]).select("id", "root")
    out = named.join(near.select("id", "n_near"), "id", "left").join(forms.drop("form_id"), "id", "left").join(roots, "id", "left")
    out = out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    out = written(out, "spelling")
    removed(words, forward, backward, near, forms, ends)
    return out


def _last(links: DataFrame) -> DataFrame:
    """``id, to`` with ``to`` followed to the end of its chain. Each round doubles the steps, and a form is at least twice as
    frequent as the word, so there are six rounds at most."""
    links = written(links, "links")
    while True:
        often = written(links.groupBy("to").agg(F.count("*").alias("n")).join(links.select(F.col("id").alias("to"), F.col("to").alias("next")), "to"), "often")
        if often.isEmpty():
            removed(often)
            return links
        moved = unskewed(links, often, ["to"], ["id"]).select("id", F.col("next").alias("to"))
        longer = written(links.join(moved.select("id"), "id", "left_anti").unionByName(moved), "links")
        removed(often, links)
        links = longer


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(counted_words(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)
), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), own AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS s, count(*) AS n FROM run GROUP BY doc_id, run
), coded AS (
  SELECT run, n, flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN ord(substr(s, i, 1)) < 128 THEN [ord(substr(s, i, 1))::BIGINT]
    ELSE [(192 | (ord(substr(s, i, 1)) >> 6))::BIGINT, (128 | (ord(substr(s, i, 1)) & 63))::BIGINT] END)) AS bytes
  FROM own
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc
), word AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM word WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM v, unnest(range(1, length(word) + 1)) u(i)
), near AS (
  SELECT x.word, y.word AS other, y.n FROM less x JOIN less y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM less x JOIN v y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM less x JOIN v y ON x.a || x.b = y.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * v.n THEN most END AS form_n,
    CASE WHEN most >= 2 * v.n THEN (SELECT min(o.other) FROM near o WHERE o.word = v.word AND o.n = best.most) END AS form
  FROM v LEFT JOIN best ON v.word = best.word
), walk AS (
  SELECT word, form, word AS at FROM formed
  UNION ALL SELECT w.word, f.form, f.word FROM walk w JOIN formed f ON w.form = f.word
)
SELECT f.word, f.form, w.at AS root, n, n_near, form_n FROM formed f JOIN walk w ON f.word = w.word AND w.form IS NULL
"""
