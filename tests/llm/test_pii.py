import hashlib
import re
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import pii

from .conftest import ODD

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
digits = lambda s: re.sub("[^0-9]", "", s)


def brute(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-+ 1274(\n)é", max_size=50))
def test_base(text):
    assert [c[:3] for c in pii.base_candidates(text) if c[3]] == brute(text)


def test_query(spark, small, small_docs):
    keys = 0
    for r in pii.op9_pii(spark, small).collect():
        text = small_docs[r["doc_id"]]
        base = brute(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [tuple(s) for s in spans if s[0] in pii.BASE] == [(k, str(a), str(b)) for k, a, b in base]
        assert r["n_email"] == sum(k == "email" for k, _, _ in base)
        keys += sum(s[0] == "key" for s in spans)
    assert keys >= 1 or not any('token = "' in t for t in small_docs.values())


def test_redaction(spark):
    model = pii.PiiModel(None, {})
    docs = spark.createDataFrame([(1, "mail a.b@c.org now, 10.0.0.1 é 4111 1111 1111 1111!", "x"), (2, "nothing", "y"), (3, None, "z")], "doc_id long, text string, spans string")
    assert [r["text"] for r in pii.redact(docs, model).orderBy("doc_id").collect()] == ["mail <email> now, <ip> é <card>!", "nothing", None]


def test_odd_rows(spark, folder):
    long = "9" * 60_000 + " " + "a" * 60_000 + "@"
    rows = pii.op9_pii(spark, folder([*ODD, (9, long)])).collect()
    assert len(rows) == len(ODD) + 1 and all(r["spans"] == "" or r["doc_id"] in (6, 9) for r in rows)
    assert pii.op9_pii(spark, folder()).count() == 0


def test_overlaps():
    taken = pii.Spans([(5, 9), (8, 12), (20, 21), (1, 2)])
    brute_spans = [(5, 9), (8, 12), (20, 21), (1, 2)]
    for a in range(25):
        for b in range(a + 1, 26):
            assert taken.meets(a, b) == any(x < b and a < y for x, y in brute_spans)
    taken.add(13, 20)
    assert taken.meets(19, 20) and not taken.meets(12, 13)


def test_many_candidates_take_linear_time():
    model = pii.PiiModel(None, {})
    text = "a1@b.org 10.1.2.3 +49 30 1234567 " * 8_000
    began = time.process_time()
    assert len(model.spans(text)) == 24_000 and time.process_time() - began < 20


def iban(rng):
    number = "DE00" + "".join(map(str, rng.integers(0, 10, 18)))
    check = 98 - int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97
    return f"DE{check:02d}{number[4:]}"


def planted(rng, words, n):
    """Texts of ordinary words with one verified base span, one span of a looser form and one look-alike each; what is planted, by kind."""
    some = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out, truth = [], []
    for i in range(n):
        card = "4" + some(14)
        card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
        base = [f"mail {rng.choice(words)}.{some(2)}@mail{i % 9}.example.com", f"tel +1 ({some(3)}) 555-{some(4)}", f"server {'.'.join(map(str, rng.integers(1, 255, 4)))}", f"card {card}"]
        token = "".join(rng.choice(list("0123456789abcdef"), 40))
        real = [("iban", iban(rng), "account "), ("key", token, 'token = "'), ("email_spelled", f"{rng.choice(words)} (at) {rng.choice(words)} (dot) org", "mail "), ("phone_local", f"({some(3)}) 555-{some(4)}", "tel ")]
        fake = [("iban", "DE00" + some(18), "part "), ("key", "-".join(rng.choice(words, 5)), "the "), ("ip", f"999.{some(3)}.300.1", "version "), ("number", some(17), "order ")]
        kind, span, cue = real[i % 4]
        _, wrong, before = fake[(i // 4) % 4]
        parts = list(rng.choice(words, 60))
        parts[10:10], parts[30:30], parts[50:50] = [base[(i // 2) % 4]], [cue + span + '"' * (kind == "key")], [before + wrong]
        text = " ".join(parts)
        out.append(text)
        truth.append((kind, text.index(span), text.index(span) + len(span)))
    return out, truth


def test_precision_and_recall_on_planted_spans(spark):
    """Trained on other texts of the same kind; what is found beside the base spans is right, and most of what is planted is found."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(3, 9))) for _ in range(600)]
    docs, _ = planted(rng, words, 1_600)
    model = pii.train(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    texts, truth = planted(rng, words, 800)
    found, wanted, right = Counter(), Counter(), Counter()
    for text, (kind, a, b) in zip(texts, truth):
        extra = [s for s in model.spans(text) if s[0] in pii.MORE]
        wanted[kind] += 1
        right[kind] += any(x < b and a < y for _, x, y in extra)
        for k, x, y in extra:
            found[k] += 1
            found[k, "right"] += x < b and a < y
    report = {k: (found[k, "right"] / found[k] if found[k] else None, right[k] / wanted[k] if wanted[k] else None) for k in pii.MORE}
    print(report)
    for kind in ("iban", "key", "email_spelled", "phone_local"):
        assert report[kind][0] >= 0.95 and report[kind][1] >= 0.9, report
    assert all(p is None or p >= 0.9 for p, _ in report.values()), report


def test_candidates_are_bounded(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert pii.train(docs, 100, 50).trees is not None


def test_a_key_of_letters_is_scored_whatever_else_is_there():
    """The same spans with and without a digit elsewhere in the text."""
    rng = np.random.default_rng(3)

    class Always:
        def score(self, x):
            return np.ones(len(x))

    model = pii.PiiModel(Always(), dict.fromkeys(pii.MORE, 0.5))
    key = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 32))
    text = f"the password={key} is secret"
    assert model.spans(text) == [("key", 13, 45)] == model.spans(text + " 7")
    assert model.spans("no span in this text") == []


def test_keys_of_letters_train_and_are_found(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    key = lambda: "".join(rng.choice(letters, 32))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(3, 9)))
    dull = lambda: "-".join(word() for _ in range(6))
    docs = [f"api_key={key()} and more" if i % 2 else f"the {dull()} of text" for i in range(600)]
    model = pii.train(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    secret = key()
    assert model.spans(f"then password={secret} was set") == [("key", 14, 46)]
    assert model.spans(f"then {dull()} again") == []


def test_every_document_trains(spark, monkeypatch):
    """The candidates of all texts make the trees, also where few cells are allowed: then bins get wider. Before, 20,000 texts did."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('order ', id, ' of card ', id % 7) AS text")
    seen = []
    cells = pii._cells
    monkeypatch.setattr(pii, "_cells", lambda rows, cuts: seen.append(rows.count()) or cells(rows, cuts))
    keys = docs.selectExpr("doc_id", "concat(text, if(doc_id % 2 = 0, ' key=', ' the '), sha1(text)) AS text")
    model = pii.train(keys, 200)
    assert seen[0] == seen[-1] >= 30_000 and len(seen) > 1, seen
    assert model.trees is not None


def test_cells_that_stay_on_the_executors_keep_their_bins(spark, monkeypatch):
    """More cells than the driver takes give the same trees and thresholds from the same bins. Before, the bins were halved until few were left."""
    monkeypatch.setattr(pii, "TREES", 6)
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(3, 9))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(planted(rng, words, 400)[0])), "doc_id long, text string")
    seen, cells = [], pii._cells
    monkeypatch.setattr(pii, "_cells", lambda rows, cuts: seen.append(cuts) or cells(rows, cuts))
    few, dealt = pii.train(docs), pii.train(docs, 50)
    assert all(len(a) == len(b) and (a == b).all() for cuts in seen for a, b in zip(seen[0], cuts, strict=True))
    assert max(map(len, seen[-1])) > 20
    assert (few.trees.feature == dealt.trees.feature).all() and (few.trees.split == dealt.trees.split).all()
    assert np.allclose(few.trees.leaf, dealt.trees.leaf, atol=1e-4) and abs(few.trees.base - dealt.trees.base) < 1e-9
    assert few.thresholds.keys() == dealt.thresholds.keys() and all(abs(few.thresholds[k] - t) < 2e-3 for k, t in dealt.thresholds.items())


def test_candidates_of_repeated_texts_count(spark, monkeypatch):
    """Each candidate of each row is in the sums; before, equal ones were one."""
    monkeypatch.setattr(pii, "TREES", 1)
    rng = np.random.default_rng(10)
    texts = [t for i, t in enumerate(planted(rng, ["some", "plain", "words"], 60)[0]) for _ in range(1 + i % 5)]
    seen, cells = [], pii._cells
    monkeypatch.setattr(pii, "_cells", lambda rows, cuts: seen.append(cells(rows, cuts).agg({"n": "sum"}).first()[0]) or cells(rows, cuts))
    for most in (pii.MOST_CELLS, 10):
        pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most)
    assert set(seen) == {sum(len(pii.labelled(t)) for t in texts)}
