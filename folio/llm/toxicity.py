"""Operator 6: toxicity scores that see through disguised words.

A disguised token (leetspeak, marks between letters, repeated letters, letters set apart by blanks) is a noisy form of a
word. Its characters span a lattice: each stands for itself, for the letters it may replace, or for nothing; Viterbi decoding
finds the cheapest path under a character trigram model, whose counts come from every text of the corpus. The restored text
is scored by words and word beginnings that labelled toxic documents have far more often than others, and a logistic
function of the strongest of them gives the score. Labels are used only from rows that are not held out.

Cases: a null text counts as empty; empty texts, and all texts while no labels of both kinds are there, get the base rate;
repeated rows and ties get equal scores; very long texts are read
whole, token by token; labels without a document, and nulls among them, are not used; only doc_id and text of
documents are read, so other columns may have any name; an empty table stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import hash_sample, table

#: About so many labelled rows at most, those with the smallest hash of their id, train the word weights and the logistic function.
MAX_LABELLED = 20_000
#: How many of the toxic documents among them must have a word or beginning, and the least log-odds, for it to be a cue.
LEAST_TOXIC, LEAST_ODDS = 4, 2.0
#: Strengths are told apart to this fraction when the logistic function is fitted.
STRENGTH_STEPS = 1000
#: Tokens remembered in each Python worker; this only saves time.
MEMO_TOKENS = 150_000
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
MARKS = ".-_*~^'`’·,"
#: Costs of the channel, as negative logs: reading a sign as a letter, dropping a sign, dropping a mark, dropping a repeated letter.
AS_LETTER, DROP_SIGN, DROP_MARK, DROP_REPEAT, KEEP_REPEAT = 0.5, 8.0, 0.5, 0.2, 3.0
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ODD = re.compile(r"[a-zA-ZÀ-ÿ][^\sa-zA-ZÀ-ÿ]+[a-zA-ZÀ-ÿ]|[0-9@$!|+(€£][a-zA-ZÀ-ÿ]|[a-zA-ZÀ-ÿ][0-9@$|+€£]|([a-zA-ZÀ-ÿ])\1\1")


def _fold_table() -> bytes:
    """Latin-1 bytes as lower-case base letters; everything else is a blank."""
    out = []
    for b in range(256):
        base = unicodedata.normalize("NFD", chr(b))[0].lower()
        out.append(base if base in _LETTERS else {"ß": "s", "ø": "o", "æ": "a"}.get(chr(b).lower(), " "))
    return "".join(out).encode()


_FOLD = _fold_table()


def fold(text: str) -> bytes:
    """``text`` with one letter of a-z or blank for each character."""
    return text.encode("latin-1", "replace").translate(_FOLD)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """27 x 27 x 27 counts of folded characters over all texts: every task adds up its own, Spark adds those."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, "int64")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes = np.frombuffer(b" " + fold(text or "") + b" ", "u1").astype("int32")
                codes = np.where(codes == 32, 0, codes - 96)
                total += np.bincount((codes[:-2] * 27 + codes[1:-1]) * 27 + codes[2:], minlength=27**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(total[some])], ["trigram", "n"])

    out = np.zeros(27**3)
    for row in docs.select("text").mapInArrow(count, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        out[row["trigram"]] = row["n"]
    return out.reshape(27, 27, 27)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Negative log of each character after each two, smoothed by the shorter contexts."""
    one = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + 27)
    pair = counts.sum(axis=0)
    two = (pair + 20 * one) / (pair.sum(axis=1, keepdims=True) + 20)
    three = (counts + 20 * two[None]) / (counts.sum(axis=2, keepdims=True) + 20)
    return -np.log(three)


def lattice(token: str) -> list[list[tuple[int, float]]]:
    """For each character the letters (1-26) it may be with their cost; 0 is nothing."""
    out: list[list[tuple[int, float]]] = []
    before = ""
    for char in token.lower():
        letter = chr(fold(char)[0]) if len(char) == 1 else " "
        ways: list[tuple[int, float]] = []
        if letter != " ":
            repeated = letter == before
            ways.append((ord(letter) - 96, KEEP_REPEAT if repeated else 0.0))
            if repeated:
                ways.append((0, DROP_REPEAT))
        else:
            ways += [(ord(x) - 96, AS_LETTER) for x in LEET.get(char, "")]
            ways.append((0, DROP_MARK if char in MARKS else DROP_SIGN))
        before = letter
        out.append(ways)
    return out


def viterbi(token: str, model: list) -> str:
    """The cheapest word of a token's lattice."""
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for ways in lattice(token):
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, word) in paths.items():
            for letter, price in ways:
                state = (b, letter) if letter else (a, b)
                total = cost + price + (model[a][b][letter] if letter else 0.0)
                if state not in step or total < step[state][0]:
                    step[state] = (total, word + _LETTERS[letter - 1] if letter else word)
        paths = step
    return min((cost + model[a][b][0], word) for (a, b), (cost, word) in paths.items())[1]


def cues(word: str) -> tuple[str, ...]:
    """What a folded word is scored by: itself and its beginnings."""
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 5 else (word, word[:4] + "*") if len(word) > 4 else (word,)


@dataclass
class Restorer:
    """Restores tokens under a character model; keeps what it has restored."""

    model: np.ndarray
    known: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._costs = self.model.tolist()

    def token(self, token: str) -> str:
        """The folded word a token stands for; '' if it has no letters."""
        word = self.known.get(token)
        if word is None:
            core = token.strip("\"'.,;:!?()[]{}<>*#%&-_~…")
            if token[:1] in "@$!|(+" and core[:1].isalpha():  # a sign at the start that may be a letter
                core = token[:1] + core
            word = viterbi(core, self._costs) if _ODD.search(core) else fold(core).decode().replace(" ", "")
            if len(self.known) >= MEMO_TOKENS:
                self.known.clear()
            self.known[token] = word
        return word

    def tokens(self, text: str) -> list[str]:
        """Tokens at white space, with runs of four or more single characters joined to one."""
        parts = text.split()
        singles = [i for i, t in enumerate(parts) if len(t) == 1]
        if len(singles) < 4:
            return parts
        out, i = [], 0
        while i < len(parts):
            j = i
            while j < len(parts) and len(parts[j]) == 1 and (parts[j].isalnum() or parts[j] in LEET):
                j += 1
            out.append("".join(parts[i:j]) if j - i >= 4 else parts[i])
            i = j if j - i >= 4 else i + 1
        return out

    def text(self, text: str) -> str:
        """The restored text: folded words, one blank apart."""
        return " ".join(w for w in map(self.token, self.tokens(text)) if w)


def restore(text: Column, model: np.ndarray) -> Column:
    """The restored text of a string column."""
    restorer = Restorer(model)  # each task has its own and keeps what it restored

    @F.arrow_udf("string")
    def restored(texts: pa.Array) -> pa.Array:
        return pa.array([restorer.text(t or "") for t in texts.to_pylist()], pa.string())

    return restored(text)


@dataclass
class ToxicityModel:
    language: np.ndarray
    weights: dict[str, float]
    logistic: np.ndarray  # of the strength of a text, and 1

    def word_weight(self, word: str) -> float:
        return max((self.weights.get(c, 0.0) for c in cues(word)), default=0.0)

    def strength(self, restorer: Restorer, known: dict[str, float], text: str) -> float:
        """The largest weight of the distinct tokens of a text, half the second and a quarter of the third."""
        tokens = set(restorer.tokens(text))
        if len(known) >= MEMO_TOKENS:
            known.clear()
        for t in tokens.difference(known):
            known[t] = self.word_weight(restorer.token(t))
        top = sorted(w for w in map(known.__getitem__, tokens) if w)[-3:][::-1]
        return sum(w / 2**i for i, w in enumerate(top))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 30, ridge: float = 0.01) -> np.ndarray:
    """Ridge logistic regression of rows that stand for ``n`` each, by Newton steps; the last column of ``x`` is 1 and is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]) + shrink * n.sum() / 100, x.T @ (n * (y - p)) - shrink @ w * n.sum() / 100)
    return w


def fold_of(doc_id: Column) -> Column:
    """0 for held-out rows, 1 to 4 for others."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> ToxicityModel:
    """Character model from all texts; weights and logistic function from labelled rows that are not held out."""
    language = language_model(trigram_counts(docs))
    sample = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic", fold_of(F.col("doc_id")).alias("fold")).where("fold != 0").distinct()
    # about MAX_LABELLED rows of three numbers, whatever ids are repeated: broadcast by that bound
    rows = docs.select("doc_id", "text").join(F.broadcast(hash_sample(sample, most, "doc_id", "toxic")), "doc_id").select("text", "toxic", "fold")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found, size = Restorer(language), [Counter(), Counter()], [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size[toxic] += 1
                found[toxic].update({c for w in set(restorer.text(text or "").split()) for c in cues(w)})
        for toxic in (0, 1):
            found[toxic][""] = size[toxic]
        names = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][c] for c in names], pa.int64()), pa.array([found[0][c] for c in names], pa.int64())], ["cue", "toxic", "clean"])

    counts = rows.where("fold != 4").select("text", "toxic").mapInArrow(counted, "cue string, toxic long, clean long").groupBy("cue").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = counts.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") * 2 > F.col("clean")) | (F.col("cue") == ""))
    # a cue is in LEAST_TOXIC of at most MAX_LABELLED documents' distinct words
    top = strong.orderBy("cue").collect()
    total = next(((r["toxic"], r["clean"]) for r in top if r["cue"] == ""), (0, 0))
    # the counts of clean documents are smoothed more, so that a rare cue never weighs like a frequent one
    odds = {r["cue"]: float(np.log((r["toxic"] + 0.5) / (total[0] + 1)) - np.log((r["clean"] + 2) / (total[1] + 4))) for r in top if r["cue"]}
    model = ToxicityModel(language, {c: w for c, w in odds.items() if w >= LEAST_ODDS}, np.array([0.0, -2.0]))
    # a histogram of strengths, whose size does not depend on the number of documents
    step = F.round(F.col("strength") * STRENGTH_STEPS).cast("int").alias("step")
    seen = add_strength(rows.where("fold = 4"), model).groupBy("toxic", step).agg(F.count("*").alias("n")).orderBy("toxic", "step").toPandas()
    y, n = seen["toxic"].to_numpy("float64"), seen["n"].to_numpy("float64")
    if total[0] and total[1] and len(y) and 0 < y.mean() < 1:
        x = np.column_stack([seen["step"].to_numpy("float64") / STRENGTH_STEPS, np.ones(len(y))])
        model.logistic = _logistic(x, y, n)
    elif sum(total):
        rate = (total[0] + 0.5) / (sum(total) + 1)
        model.logistic = np.array([0.0, np.log(rate / (1 - rate))])
    return model


def add_strength(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``strength``, from the weights of the restored text's words."""
    restorer, known = Restorer(model.language), {}  # each task has its own and keeps what it restored

    @F.arrow_udf("double")
    def strength(texts: pa.Array) -> pa.Array:
        return pa.array([model.strength(restorer, known, t or "") for t in texts.to_pylist()], pa.float64())

    return docs.withColumn("strength", strength("text"))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``."""
    slope, shift = map(float, model.logistic)
    margin = F.col("strength") * slope + shift
    scored = add_strength(docs.drop("held_out", "score", "predicted", "strength"), model).withColumn("score", 1 / (1 + F.exp(-margin)))
    return scored.withColumn("held_out", fold_of(F.col("doc_id")) == 0).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).drop("strength")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")
