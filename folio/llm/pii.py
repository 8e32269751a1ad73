"""Operator 9: personal data by boosted candidates.

Generators of high recall propose spans, which may overlap: the base forms (e-mail, IP, card, phone), and looser ones
(disguised e-mail, national phone, long keys, account and social-security numbers, MAC addresses). Each candidate is
described by its format and its context, and boosted trees score it. There are no labelled spans, so the trees learn from
evidence that the features do not hold: whether a checksum or range is right, whether the candidate lies in a base span
that was verified, and, for keys, what stands before them (for keys the features describe the format alone). Forms that have
no such evidence are trained on verified spans written in that form at their own place, and against them are set the same
forms with other digits, or made of ordinary words, at an ordinary place of the text. A candidate that fails a check its form
has is dropped, and what passes by chance counts as such when the threshold of each kind is calibrated on held-out candidates.
Base spans always stay; of overlapping others the best-scored stays.

Cases: a null text counts as empty and has no spans; offsets are in code points; repeated rows get equal rows; of equally scored
overlapping spans the first kind, then the first start, stays; if the texts have no candidates of both classes, base spans alone
are found; columns named like a result are replaced; an empty table stays empty; very long texts are scanned in linear time, and
overlaps by binary search.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.boosting import Boosted, coded_margin, codes_of, fit, fit_dealt
from folio.llm.common import release, removed, table, written

#: Most cells of candidates with equal bins that come to the driver to make the trees there, and that a task has where more of them
#: make the trees on the executors; and the bins of a feature. Neither leaves out a candidate or a bin.
MOST_CELLS, BINS = 100_000, 48
#: Of a margin's unit so many steps tell held-out candidates on the executors apart.
STEPS = 1_000
#: Trees, and their depth.
TREES, DEPTH = 50, 4
#: Least precision of each kind on held-out candidates.
PRECISION = 0.98
BASE = ["email", "ip", "card", "phone"]
MORE = ["key", "email_spelled", "phone_local", "iban", "ssn", "mac", "number"]
KINDS = BASE + MORE
#: Of wrong candidates one in so many passes the check of its form: two check digits of 97, the digit of Luhn.
CHANCE = {"iban": 97.0, "number": 10.0}
#: Words that announce personal data.
CUES = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "telefono", "móvil", "handy"),
    "key": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "key": re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"),
    "email_spelled": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?[(\[{]\s?at\s?[)\]}]\s?[A-Za-z0-9-]{1,64}(?:\s?[(\[{]\s?dot\s?[)\]}]\s?[A-Za-z0-9-]{1,24}|\.[A-Za-z0-9-]{1,24}){1,4}", re.I),
    "phone_local": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}[ ]?[A-Z0-9]{0,3}(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"),
    "number": re.compile(r"(?<![0-9A-Za-z])[0-9][0-9 ().-]{7,30}[0-9](?![0-9A-Za-z])"),
}


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def iban_ok(text: str) -> bool:
    packed = text.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is whatever of its characters stands before the at sign, back to the last match."""
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, passes)`` of the base forms, leftmost and without overlap within a kind."""
    out: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        out += [("email", a, b, True) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        out.append(("card", m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        out += [("phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15) for m in _PHONE.finditer(text)]
    return out


def loose_candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, pattern in _LOOSE.items() for m in pattern.finditer(text)]


_CUE_KINDS = list(CUES)
_CONTEXT = 24


def describe(span: str, before: str, after: str, kind: str) -> list[float]:
    """Format and context of a candidate; of keys the format alone."""
    n = len(span)
    digits, letters = sum("0" <= c <= "9" for c in span), sum(c.isalpha() for c in span)
    counts = [span.count(c) for c in set(span)]
    entropy = -sum(k / n * math.log2(k / n) for k in counts)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", span) if g]
    form = [
        float(KINDS.index(kind)),
        n,
        digits,
        letters,
        digits / n,
        sum(c.isupper() for c in span) / n,
        sum(c in "0123456789abcdefABCDEF" for c in span) / n,
        entropy,
        switches / n,
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
    ]
    if kind == "key":
        return form + [0.0] * (6 + len(_CUE_KINDS))
    before, after = before[-_CONTEXT:].lower(), after[:8]
    return [
        *form,
        float(before[-1:] in ("=", ":", '"', "'")),
        float(before[-2:] in ("= ", ": ", '="', ':"')),
        float("=" in before[-6:] or ":" in before[-6:]),
        float(after[:1] in ('"', "'")),
        float(not before or before[-1:].isspace()),
        float(not after or after[:1].isspace() or after[:1] in ".,;)"),
        *[float(any(cue in before for cue in CUES[k])) for k in _CUE_KINDS],
    ]


def described(text: str, kind: str, start: int, end: int) -> list[float]:
    return describe(text[start:end], text[max(0, start - _CONTEXT) : start], text[end : end + 8], kind)


def ssn_ok(span: str) -> bool:
    return not span.startswith(("000", "666", "9")) and span[4:6] != "00" and span[7:] != "0000"


def passes(kind: str, span: str) -> bool:
    """Whether a loose candidate passes the check of its form; true where it has none."""
    if kind == "iban":
        return iban_ok(span)
    if kind == "ssn":
        return ssn_ok(span)
    digits = _digits(span)
    return kind != "number" or 13 <= len(digits) <= 19 and luhn(digits)


class Spans:
    """Spans laid down so far, as disjoint sorted ranges."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.ends) and self.starts[k] < end

    def add(self, start: int, end: int) -> None:
        """A range that meets none of them."""
        k = bisect_right(self.ends, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def labelled(text: str) -> list[tuple[str, int, list[float]]]:
    """``(kind, label, features)`` of the candidates of a text that some evidence outside the features can judge."""
    base = base_candidates(text)
    good = {kind: Spans([(a, b) for k, a, b, ok in base if ok and k == kind]) for kind in BASE}
    out = [(k, int(ok), described(text, k, a, b)) for k, a, b, ok in base if ok or k in ("card", "ip")]
    for kind, a, b in loose_candidates(text):
        inside = [k for k in BASE if good[k].meets(a, b)]
        if kind in ("iban", "ssn"):
            label = int(passes(kind, text[a:b]))
        elif kind == "number":
            label = int("phone" in inside or passes(kind, text[a:b]))
        elif kind == "phone_local" and inside:
            label = int("phone" in inside)
        elif kind == "key":
            before = text[max(0, a - _CONTEXT) : a].lower()
            label = int(any(cue in before for cue in CUES["key"]) or before.rstrip("\"' ")[-1:] in ("=", ":"))
        else:
            continue
        out.append((kind, label, described(text, kind, a, b)))
    return out + _rewritten(text, [(k, a, b) for k, a, b, ok in base if ok])


def _rewritten(text: str, verified: list[tuple[str, int, int]]) -> list[tuple[str, int, list[float]]]:
    """Verified spans in a looser form at their own place, and look-alikes of that form at an ordinary place."""
    out: list[tuple[str, int, list[float]]] = []
    for kind, a, b in verified:
        span, before, after = text[a:b], text[max(0, a - _CONTEXT) : a], text[b : b + 8]
        seed = zlib.crc32(span.encode("utf-8", "surrogatepass"))
        # an ordinary place: three words from a place that the span's hash gives
        at = seed % max(1, len(text))
        words = re.findall(r"[^\W\d_]+", text[at : at + 120])[1:4] or ["word"]
        far_before, far_after = text[max(0, at - _CONTEXT) : at], " "
        some = f"{seed * 2654435761 % 10**16:016d}"
        if kind == "email":
            name, host = span.split("@", 1)
            # the whole address, and a short one without its digits and subdomains
            short = [re.sub("[^A-Za-z]", "", part) or words[0] for part in (name, *host.split(".")[-2:])]
            for one in (f"{name} (at) {host.replace('.', ' (dot) ')}", f"{short[0]} (at) {short[1]} (dot) {short[2]}"):
                out.append(("email_spelled", 1, describe(one, before, after, "email_spelled")))
            for wrong in (f"{words[0]} (at) {words[-1]}.{words[len(words) // 2]}", f"{words[-1]} (at) {some[:2]}.{some[2:4]}"):
                out.append(("email_spelled", 0, describe(wrong, far_before, far_after, "email_spelled")))
        elif kind == "ip":
            pairs = [f"{(seed >> k) * 40503 % 256:02x}" for k in range(6)]
            out.append(("mac", 1, describe(":".join(pairs), before, after, "mac")))
            out.append(("mac", 0, describe("-".join(some[k : k + 2] for k in range(0, 12, 2)), far_before, far_after, "mac")))
        elif kind == "card":
            number = "DE00" + some + "42"
            check = 98 - int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97
            account = f"DE{check:02d}{number[4:]}"
            out.append(("iban", 1, describe(" ".join(account[k : k + 4] for k in range(0, 22, 4)), before, after, "iban")))
            out.append(("iban", 0, describe(" ".join(number[k : k + 4] for k in range(0, 22, 4)), far_before, far_after, "iban")))
            out.append(("number", 0, describe(some[: len(_digits(span))], far_before, far_after, "number")))
            out.append(("ssn", 1, describe(f"{1 + int(some[:3]) % 665:03d}-{some[3:5]}-{some[5:9]}", before, after, "ssn")))
            out.append(("ssn", 0, describe(f"9{some[1:3]}-{some[3:5]}-{some[5:9]}", far_before, far_after, "ssn")))
    return out


@dataclass(frozen=True)
class PiiModel:
    trees: Boosted | None
    thresholds: dict[str, float]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans of a text: the base ones, then what the trees select among the others."""
        # without a digit or an at sign there are only these
        if not re.search(r"[0-9@]", text) and not any(_LOOSE[kind].search(text) for kind in ("key", "email_spelled")):
            return []
        base = [(kind, a, b) for kind, a, b, ok in base_candidates(text) if ok]
        taken = Spans([(a, b) for _, a, b in base])
        loose = [c for c in loose_candidates(text) if not taken.meets(c[1], c[2]) and passes(c[0], text[c[1] : c[2]])] if self.trees else []
        if loose:
            scores = self.trees.score(np.array([described(text, *c) for c in loose]))
            chosen = [(s, c) for s, c in zip(scores.tolist(), loose, strict=True) if s >= self.thresholds.get(c[0], 2.0)]
            for _, c in sorted(chosen, key=lambda x: (-x[0], KINDS.index(x[1][0]), x[1][1])):
                if not taken.meets(c[1], c[2]):
                    taken.add(c[1], c[2])
                    base.append(c)
        return sorted(base, key=lambda c: (KINDS.index(c[0]), c[1]))


def train(docs: DataFrame, most: int = MOST_CELLS, bins: int = BINS) -> PiiModel:
    """Trees and thresholds from all labelled candidates of all documents, of repeated texts too.

    Trees and thresholds depend on the bins of the features only, so candidates with equal bins are one cell with their number.
    If these are more than ``most`` they stay on the executors, with the same bins, and the trees are made from sums over them.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [(fold, *c) for fold, text in zip(batch.column(0)[at : at + 64].to_pylist(), batch.column(1)[at : at + 64].to_pylist(), strict=True) for c in labelled(text)]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.float64()))], ["fold", "kind", "y", "x"])
            release()

    fold = F.pmod(F.xxhash64("text"), F.lit(4)).cast("int")
    rows = docs.where(F.col("text").rlike("[0-9@]|[A-Za-z_-]{20}")).select(fold.alias("fold"), "text").mapInArrow(candidates, "fold int, kind string, y int, x array<double>")
    # equal candidates, as of repeated texts, are one row with their number
    table_of = written(rows.groupBy("fold", "kind", "y", "x").agg(F.count("*").alias("n")), "candidates")
    cuts = _cuts(table_of.where("fold > 0"), bins)
    if not cuts:
        removed(table_of)
        return PiiModel(None, {})
    count = _cells(table_of, cuts).count()
    cells = written(_cells(table_of, cuts).repartition(-(-count // MOST_CELLS)), "cells")
    model = _trained(cells, cuts) if count <= most else _trained_dealt(cells, cuts)
    removed(table_of, cells)
    return model


def _trained(cells: DataFrame, cuts: list[np.ndarray]) -> PiiModel:
    """The model of few cells, made on the driver."""
    data = cells.orderBy("fold", "kind", "y", "cell").toPandas()
    y, fold, kinds, n = data["y"].to_numpy(), data["fold"].to_numpy(), data["kind"].to_numpy(), data["n"].to_numpy()
    codes = np.frombuffer(b"".join(data["cell"]), "u1").reshape(len(data), -1)
    # a value of each bin: its upper cut, or one above all
    x = np.stack([np.append(c, np.inf)[codes[:, f]] for f, c in enumerate(cuts)], axis=1)
    trees = fit(x[fold > 0], y[fold > 0], trees=TREES, depth=DEPTH, weight=n[fold > 0], cuts=cuts)
    if trees is None:
        return PiiModel(None, {})
    score = trees.score(x)
    held = {k: (kinds == k) & (fold == 0) for k in MORE}
    return PiiModel(trees, {k: _threshold(score[h], y[h], CHANCE.get(k, 1.0), n[h]) for k, h in held.items()})


def _trained_dealt(cells: DataFrame, cuts: list[np.ndarray]) -> PiiModel:
    """The model of any number of cells, which stay on the executors."""
    fitted = fit_dealt(cells.where("fold > 0").select("y", "n", "cell"), cuts, TREES, DEPTH)
    if fitted is None:
        return PiiModel(None, {})
    trees, cut = fitted

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.floor(coded_margin(codes_of(batch), trees.feature, cut, trees.leaf, trees.base).clip(-30, 30) * STEPS)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("y"), pa.array(step.astype("i4")), batch.column("n")], ["kind", "y", "step", "n"])

    held = cells.where("fold = 0").mapInArrow(steps, "kind string, y int, step int, n long").groupBy("kind", "y", "step").agg(F.sum("n").alias("n"))
    data = held.orderBy("kind", "y", "step").toPandas()
    y, kinds, n = data["y"].to_numpy(), data["kind"].to_numpy(), data["n"].to_numpy()
    score = 1 / (1 + np.exp(-data["step"].to_numpy() / STEPS))
    return PiiModel(trees, {k: _threshold(score[kinds == k], y[kinds == k], CHANCE.get(k, 1.0), n[kinds == k]) for k in MORE})


def _cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Quantiles of each feature of ``rows(x, n)``, counted over all of them; values are rounded for it, so that a bounded number is counted."""
    values = rows.select(F.posexplode("x").alias("f", "v"), "n").select("f", F.round(F.least("v", F.lit(512.0)), 2).alias("v"), "n")
    counts = values.groupBy("f", "v").agg(F.sum("n").alias("n")).orderBy("f", "v").toPandas()
    out = []
    for _, one in counts.groupby("f"):
        upto = one["n"].to_numpy().cumsum()
        out.append(np.unique(one["v"].to_numpy()[np.searchsorted(upto, np.linspace(0, 1, bins + 1)[1:-1] * upto[-1])]))
    return out


def _cells(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``fold, kind, y, cell, n``: how many of ``rows(fold, kind, y, x, n)`` have the bins ``cell``, a byte a feature."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if cuts else np.zeros((len(x), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in codes.astype("u1")], pa.binary()), batch.column(4)], ["fold", "kind", "y", "cell", "n"])

    return rows.mapInArrow(coded, "fold int, kind string, y int, cell binary, n long").groupBy("fold", "kind", "y", "cell").agg(F.sum("n").alias("n"))


def _threshold(score: np.ndarray, y: np.ndarray, chance: float, n: np.ndarray) -> float:
    """The least score from which on the precision is high enough, where of wrong candidates one in ``chance`` is proposed; no
    candidate reaches the threshold where none is high enough, or nothing was held out. A row stands for ``n`` candidates."""
    if not len(score) or not y.any():
        return 2.0
    order = np.argsort(-score, kind="stable")
    right, wrong = np.cumsum((n * y)[order]), np.cumsum((n * (1 - y))[order]) / chance
    last = np.append(np.diff(score[order]) != 0, True)  # equal scores are taken or left together
    precise = (right / np.maximum(right + wrong, 1e-9) >= PRECISION) & last
    # even odds at least, once the check is passed
    return max(1 / (1 + chance), float(score[order][np.flatnonzero(precise)[-1]])) if precise.any() else 2.0


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find(text: Column, model: PiiModel) -> Column:
    """The spans of a string column, by kind and then by start; offsets in code points, ends exclusive."""

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        out = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in model.spans(t.as_py() or "")] for t in texts], kind)  # one text at a time
        release()
        return out

    return found(text)


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; texts without spans stay as they are."""

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            text, parts, done = value.as_py(), [], 0
            for a, b, k in sorted((a, b, k) for k, a, b in model.spans(text or "")):
                if a >= done:
                    parts += [text[done:a], f"<{k}>"]
                done = max(done, b)  # of overlapping spans the first names them all
            out.append("".join([*parts, text[done:]]) if parts else text)
        out = pa.array(out, pa.string())
        release()
        return out

    return docs.select(*[redacted("text").alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = docs.select("doc_id", find(F.col("text"), train(docs)).alias("s"))
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["kind"].isin(BASE))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"))
