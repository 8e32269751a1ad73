"""Operator 2: quality rules.

Two base rules (too few words, too much repetition) and a verdict of gradient-boosted trees over document statistics. The
trees are trained on labelled documents, are monotone in the statistics that only ever speak against a text, and are scored
as flat numpy arrays on whole Arrow batches. The threshold is set from out-of-fold scores so that at most ``SPARE`` of the
labelled good documents fall under it.

Cases: a null text has no words; so have empty and blank ones: they fail the base rule; repeated rows, and other ties, get equal verdicts;
very long texts are counted whole;
without labels of both kinds the base rules alone decide; a column that has the name of a statistic is replaced by it; an
empty table stays empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.boosting import Boosted, fit
from folio.llm.common import hash_sample, release, removed, table, written

#: About so many labelled rows at most train the trees, those with the smallest hash of their id. Everything else covers all rows.
MAX_LABELLED = 20_000
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Share of good labelled documents that the threshold may cost.
SPARE = 0.001
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
#: Features that must never raise the score as they grow.
FEATURES = ["log_words", "chars_a_word", "symbols_a_word", "dup_lines", "repeat_words", "words_a_line", "upper", "digits", "marks_a_word", "distinct"]
FALLING = ["symbols_a_word", "dup_lines", "repeat_words", "upper", "digits"]
_WORD, _UPPER, _DIGIT, _MARK = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[.,;:!?]")


def _repeated(words: list[str]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more; distinct words."""
    codes: dict[str, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], "int64")
    if len(ids) < 4:
        return 0, len(codes)
    pairs = ids[:-1] * len(codes) + ids[1:]
    if len(codes) > 1_500_000:  # three codes would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(codes) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    inside = np.zeros(len(ids), bool)
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    for shift in range(3):
        inside[shift : shift + len(windows)] |= twice
    return int(inside.sum()), len(codes)


def text_stats(text: str) -> tuple[int, ...]:
    """STATS of one whole text."""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeated, distinct = _repeated(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(_UPPER.findall(text)),
        len(_DIGIT.findall(text)),
        len(_MARK.findall(text)),
        distinct,
    )


def stats(text: Column) -> Column:
    """A struct of the STATS (long) of a string column."""

    @F.arrow_udf("struct<" + ", ".join(f"{s}: long" for s in STATS) + ">")
    def of(texts: pa.Array) -> pa.Array:
        rows = np.array([text_stats(t.as_py() or "") for t in texts], "int64").reshape(-1, len(STATS))  # one text at a time
        release()
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATS))], STATS)

    return of(text)


def features(rows: np.ndarray) -> np.ndarray:
    """FEATURES from rows of STATS."""
    words, chars, symbols, dup, repeat, lines, upper, digits, marks, distinct = rows.astype("float64").T
    each, every = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(words), chars / each, symbols / each, dup / np.maximum(lines, 1), repeat / each, words / np.maximum(lines, 1), upper / every, digits / every, marks / each, distinct / each], axis=1)


@dataclass(frozen=True)
class QualityModel:
    trees: Boosted | None
    threshold: float

    def good(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and verdict of rows of STATS."""
        if self.trees is None:
            return np.full(len(rows), 0.5), np.ones(len(rows), bool)
        score = self.trees.score(features(rows))
        return score, score >= self.threshold


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> QualityModel:
    """Trees from about ``most`` labelled documents at most."""
    sample = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    # about MAX_LABELLED rows of two numbers, whatever ids are repeated: broadcast by that bound
    sample = F.broadcast(hash_sample(sample, most, "doc_id", "quality"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "quality", stats(F.col("text")).alias("s"))
    # one id may have any number of rows: equal ones are one here, and of the others no more than the bound are taken
    rows = written(rows.select("doc_id", "quality", "s.*").distinct(), "labelled")
    data = hash_sample(rows, most, "doc_id", "quality", *STATS).orderBy("doc_id", "quality", *STATS).toPandas()
    removed(rows)
    monotone = {FEATURES.index(f): -1 for f in FALLING}
    x, y = features(data[STATS].to_numpy().reshape(-1, len(STATS))), data["quality"].to_numpy()
    trees = fit(x, y, monotone)
    if trees is None:
        return QualityModel(None, 0.5)
    held = np.full(len(y), np.nan)
    fold = data["doc_id"].to_numpy() % 3
    for k in range(3):
        part = fit(x[fold != k], y[fold != k], monotone)
        held[fold == k] = part.score(x[fold == k]) if part else 0.5
    good = np.sort(held[y == 1])
    return QualityModel(trees, float(min(0.5, good[int(SPARE * len(good))])))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with the STATS, ``base_failed``, ``quality_score`` and ``kept``."""

    @F.arrow_udf("struct<score: double, good: boolean>")
    def judged(*columns: pa.Array) -> pa.Array:
        score, good = model.good(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1))
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(good, pa.bool_())], ["score", "good"])

    named = docs.drop(*STATS, "base_failed", "quality_score", "kept", "_stats", "_verdict").withColumn("_stats", stats(F.col("text")))
    scored = named.withColumn("_verdict", judged(*[F.col(f"_stats.{s}") for s in STATS]))
    failed = (F.col("_stats.n_words") < LEAST_WORDS) | (F.col("_stats.n_repeat_words") * 100 > F.col("_stats.n_words") * MOST_REPEATED_PERCENT)
    return scored.select(
        *[c for c in named.columns if c != "_stats"],
        *[F.col(f"_stats.{s}").alias(s) for s in STATS],
        failed.alias("base_failed"),
        F.col("_verdict.score").alias("quality_score"),
        (~failed & F.col("_verdict.good")).alias("kept"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *STATS[:5], "base_failed", "kept", "quality_score")
