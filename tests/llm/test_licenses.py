import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, TemplateIndex, op5_licenses, phrase_places, scan, words_of

from .conftest import ODD

WORDS = sorted({w.decode() for _, t in TEMPLATES for w in words_of(t)}) + ["other", "words", "é"]


def test_words():
    text = "GNU Général_Public x86's ÉÀ b"
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in words_of(text)] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=40), st.integers(0, 10**6))
def test_join_is_exact(words, seed):
    frequency = {w.encode(): hash((seed, w)) % 100 for w in WORDS}
    index = TemplateIndex(frequency, TEMPLATES, THRESHOLD)
    block = {w.encode() for w in words}
    expected = []
    for label, template in TEMPLATES:
        own = set(words_of(template))
        if len(own & block) >= THRESHOLD * len(own) - 1e-9:
            expected.append((label, len(own & block) / len(own)))
    assert sorted(index.matches([w.encode() for w in words])) == sorted(expected)


def test_places():
    words = words_of("MIT license, mit-license; the mit licenses GNU General Public License cc by cc by")
    naive = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split())
    assert sorted(phrase_places(words)) == naive and len(naive) == 5


def test_many_places_are_found_in_linear_time():
    words = words_of("MIT license, " * 60_000)
    began = time.process_time()
    assert [at for at, _ in phrase_places(words)] == list(range(0, 120_000, 2)) and time.process_time() - began < 5


def test_query(spark, folder):
    docs = [(10, "Some text.\nLicensed under CC BY-NC 4.0.\nmore"), (11, "Released under the MIT License"), (12, "This work is licensed under the GNU General Public License, version 3."), (13, "no licence here, by the way")]
    rows = {r["doc_id"]: r for r in op5_licenses(spark, folder(docs + [(20 + i, t) for i, (_, t) in enumerate(ODD)])).collect()}
    assert (rows[10]["base_labels"], rows[10]["labels"], rows[10]["first_word"], rows[10]["n_base"]) == ("cc-by", "cc-by,cc-by-nc", 4, 1)
    assert (rows[11]["labels"], rows[12]["labels"]) == ("mit", "gpl,gpl-3.0")
    assert (rows[13]["labels"], rows[13]["score"], rows[13]["last_word"]) == ("", 0.0, None) and rows[21]["n_words"] == 0
    assert op5_licenses(spark, folder()).count() == 0


def test_wrapped_notices(spark, folder):
    """Each template is found when it is wrapped after every few words and stands among others."""
    texts = {}
    for k, (_, template) in enumerate(TEMPLATES):
        parts = template.split()
        for width in (3, 7):
            lines = [" ".join(parts[i : i + width]) for i in range(0, len(parts), width)]
            texts[10 * k + width] = "\n".join(["Other words stand here.", *lines, "and here too."])
    texts[500] = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    texts[501] = "Permission is hereby granted.\n" + "other words here\n" * 20 + "free of charge, to any person obtaining a copy\n" + "more\n" * 20 + "of this software and associated documentation files"
    rows = {r["doc_id"]: r for r in op5_licenses(spark, folder(list(texts.items()))).collect()}
    for k, (label, _) in enumerate(TEMPLATES):
        for width in (3, 7):
            row = rows[10 * k + width]
            assert label in row["labels"].split(",") and row["score"] == 1.0, (label, width, row)
            assert not ({"gpl-2.0", "gpl-3.0", "lgpl"} - {label}) & set(row["labels"].split(",")), (label, row)
    assert (rows[500]["labels"], rows[501]["labels"]) == ("mit", "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=80), st.integers(0, 10**6))
def test_windows_are_exact(words, seed):
    index = TemplateIndex({w.encode(): hash((seed, w)) % 100 for w in WORDS}, TEMPLATES, THRESHOLD)
    coded, expected = [w.encode() for w in words], []
    for k, (_, template) in enumerate(TEMPLATES):
        own, width = set(words_of(template)), index.width[k]
        for i, w in enumerate(coded):
            common = own & set(coded[i : i + width])
            if w in own and len(common) >= THRESHOLD * len(own) - 1e-9:
                expected.append((k, len(common) / len(own), i))
    assert sorted((k, s, min(p)) for k, s, p in index.windows(coded)) == sorted(expected)


def test_whole_documents_against_brute_force(spark, small, small_docs):
    """Each label of the given texts is one that some line or some window of some template's words gives, and the other way round."""
    got = {r["doc_id"]: r for r in op5_licenses(spark, small).collect()}
    for d, text in small_docs.items():
        found, words = {}, words_of(text)
        for k, (label, template) in enumerate(TEMPLATES):
            own, width = set(words_of(template)), int(len(words_of(template)) / THRESHOLD + 1e-9)
            blocks = [line for line in map(words_of, text.split("\n")) if len(line) <= width] + [words[i : i + width] for i, w in enumerate(words) if w in own]
            best = max((len(own & set(b)) for b in blocks), default=0)
            if best >= THRESHOLD * len(own) - 1e-9:
                found[k] = (label, best / len(own))
        labels = set(got[d]["labels"].split(",")) - {""}
        base = {label for _, label in phrase_places(words)}
        # of variants in one place the best counts, so a template of equal or less containment may be left out, and no other
        assert base <= labels <= base | {label for label, _ in found.values()}
        assert not found or labels & {label for label, s in found.values() if s == max(x for _, x in found.values())}


def test_extra_columns(spark):
    frame = spark.createDataFrame([(1, "Released under the MIT License", 5, "x")], "doc_id long, text string, n_words int, labels string")
    row = scan(frame).first()
    assert (row["n_words"], row["labels"]) == (5, "mit")


def test_two_notices_in_a_line(spark, folder):
    apache, mit, filler = "Licensed under the Apache License 2.0", "Released under the MIT License", " some other words" * 50 + " "
    both = [f"{mit}. {apache}.", f"{apache}; {mit}", mit + filler + apache, apache + filler + mit]
    gpl = TEMPLATES[10][1]
    docs = list(enumerate([*both, gpl, f"{gpl}. {TEMPLATES[11][1]}", f"{apache}.\n{gpl}."]))
    rows = {r["doc_id"]: r["labels"].split(",") for r in op5_licenses(spark, folder(docs)).collect()}
    for k in range(4):
        assert {"apache-2.0", "mit"} <= set(rows[k]), rows[k]
    assert rows[4] == ["gpl", "gpl-2.0"] and rows[5] == ["gpl", "gpl-2.0", "gpl-3.0"]
    assert rows[6] == ["apache", "apache-2.0", "gpl", "gpl-2.0"]


def test_words_scattered_over_a_long_line_are_no_notice(spark, folder):
    filler = " ".join(f"w{k}" for k in range(400))
    scattered = f"it was released {filler} under the bridge {filler} a fishing license"
    near = f"{filler} released under the fine mit license {filler}"
    rows = {r["doc_id"]: (r["labels"], r["score"]) for r in op5_licenses(spark, folder([(1, scattered), (2, near), (3, scattered.replace(" ", "\n"))])).collect()}
    assert rows[1] == rows[3] == ("", 0.0) and rows[2][0] == "mit"
