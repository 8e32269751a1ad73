import itertools
import random
import zlib

import numpy as np

from folio.llm.toxicity import AS_LETTER, Restorer, fold, language_model, lattice, op6_toxicity, score_toxicity, train, trigram_counts, viterbi

from .conftest import ODD

CLEAN = "the river runs over stones and many small boats wait near the old bridge while people walk home".split()
BAD = ["idiot", "stupid", "moron"]


def corpus(n=400):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            word = rng.choice(BAD)
            if zlib.crc32(str(i).encode()) % 5 == 0:  # disguised only where it is held out
                word = rng.choice([word.replace("i", "1").replace("o", "0"), " ".join(word), word[0] + word[1] * 4 + word[2:], ".".join(word)])
            words[rng.randrange(30)] = word
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_fold_and_counts(spark):
    assert fold("Éa ß漢1") == b"ea s  "
    counts = trigram_counts(spark.createDataFrame([("ab",), (None,), ("",)], "text string"))
    assert counts.sum() == 2 and counts[0, 1, 2] == 1 and counts[1, 2, 0] == 1


def test_restores(spark):
    docs = [(" ".join(CLEAN + BAD * 3),)] * 5
    restorer = Restorer(language_model(trigram_counts(spark.createDataFrame(docs, "text string"))))
    assert restorer.text("1d10t st.up.id mooooron r1ver") == "idiot stupid moron river"
    assert restorer.text("a s t u p i d boat") == "astupid boat" and restorer.text("s t u p i d") == "stupid"
    assert restorer.text("Bridge, (home) !!! 42") == "bridge home"


def test_held_out(spark, folder):
    docs, labels = corpus()
    rows = op6_toxicity(spark, folder(docs, labels)).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_odd_rows(spark, folder):
    rows = op6_toxicity(spark, folder(ODD, [(4, 1, 1), (None, 1, 1), (77, 0, None)])).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert op6_toxicity(spark, folder()).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(9)
    model = language_model(rng.integers(0, 50, (27, 27, 27)).astype(float))
    costs = model.tolist()
    for token in ("1d0t", "st.p", "b00k", "a55", "h3!!", "$o", "aabb"):
        best = None
        for path in itertools.product(*lattice(token)):
            letters = [0, 0, *[x for x, _ in path if x], 0]
            cost = sum(p for _, p in path) + sum(model[a, b, c] for a, b, c in zip(letters, letters[1:], letters[2:]))
            word = "".join(chr(96 + x) for x in letters if x)
            best = min(best, (cost, word)) if best else (cost, word)
        found = viterbi(token, costs)
        letters = [0, 0, *[ord(x) - 96 for x in best[1]], 0]
        assert found == best[1], (token, found, best)
    assert AS_LETTER > 0


def test_clashing_columns_and_a_frequent_id(spark):
    docs, labels = corpus(200)
    rows = [(i, t, 5, "x") for i, t in docs] + [(3, docs[3][1], 5, "x")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int, strength string")
    marks = spark.createDataFrame([(i, t) for i, _, t in labels] * 2, "doc_id long, toxic int")
    got = score_toxicity(frame, train(frame, marks, 100)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and "strength" not in got[0].asDict()
