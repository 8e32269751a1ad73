"""Operator 5: license scans as an exact set-similarity join of text blocks with notice templates.

A block is a window of consecutive words, over lines, as long as a template's word count / ``THRESHOLD``, so that
wrapped notices are found too, or a line that is no longer than that. As a set of words it matches a template that has at least ``THRESHOLD`` of its words there. The words of
the templates are put in one global order, rarest in the corpus first (counted over all documents by Spark). A block can only
reach the threshold if it holds one of a template's first ``size - need + 1`` words in that order (prefix filter), has at
least ``need`` of the templates' words at all (length filter) and has enough of them left after the first common one
(positional filter); what passes is verified word by word. The templates are a small fixed list, so their index goes to every
task. A block is labelled by all templates it matches, but of variants, which mostly share their words in place, by the best. Phrases of the base rule are found apart from that.

Cases: a null text counts as empty and has no words; repeated rows get equal rows; several licenses in a text give several
labels, of equally good templates both; very long texts are scanned word by word, and windows only near a template's rarest
words; columns of ``docs`` named like a result are replaced; an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table

THRESHOLD = 0.8
#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Labels and notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced or transmitted without prior written permission"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
]
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # UTF-8 bytes, after bytes.lower(), which changes A-Z only


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """``(first word, label)`` of every place of every base phrase."""
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in PHRASES.items():
        wanted, at, word, counted = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := joined.find(wanted, at + 1)) >= 0:
            word, counted = word + joined.count(b" ", counted, at), at  # on from the last place: linear in the text
            places.append((word, label))
    return places


class TemplateIndex:
    """Prefix index of the templates under a global word order."""

    def __init__(self, frequency: dict[bytes, int], templates: list[tuple[str, str]], threshold: float):
        sets = [frozenset(words_of(t)) for _, t in templates]
        order = sorted(frozenset().union(*sets), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.labels = [label for label, _ in templates]
        self.words = [sorted(self.rank[w] for w in s) for s in sets]
        self.sets = [frozenset(ranks) for ranks in self.words]
        self.width = [math.floor(len(words_of(t)) / threshold + 1e-9) for _, t in templates]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, ranks in enumerate(self.words):
            for at, r in enumerate(ranks[: len(ranks) - self.need[k] + 1]):
                self.prefix.setdefault(r, []).append((k, at))
        self.first = frozenset(w for w, r in self.rank.items() if r in self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Label and containment of all templates that a block's words meet."""
        return [(self.labels[k], score) for k, score in self.met(words)]

    def met(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Number and containment of all templates that a block's words meet."""
        block = sorted({self.rank[w] for w in words if w in self.rank})
        seen: set[int] = set()
        found = []
        for j, r in enumerate(block):
            for k, at in self.prefix.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)  # the first common word: later ones can only have less to come
                size, need = len(self.words[k]), self.need[k]
                if len(block) >= need and 1 + min(size - at - 1, len(block) - j - 1) >= need:
                    common = len(set(self.words[k]).intersection(block))
                    if common >= need:
                        found.append((k, common / size))
        return found

    def windows(self, words: list[bytes]) -> list[tuple[int, float, frozenset[int]]]:
        """Number of a template, containment and first places of its words, for each window of a text that meets it.

        A window starts at a word of the template and is ``width`` words long; it must hold a prefix word, so only the
        neighbourhoods of those are searched.
        """
        ranked = [(at, self.rank[w]) for at, w in enumerate(words) if w in self.rank]
        anchors: dict[int, list[int]] = {}
        for at, r in ranked:
            for k, _ in self.prefix.get(r, ()):
                anchors.setdefault(k, []).append(at)
        present = {r for _, r in ranked}
        found = []
        for k, places in anchors.items():
            own, need, width = self.sets[k], self.need[k], self.width[k]
            if len(own & present) < need:
                continue
            done = -1
            for anchor in places:
                low, high = max(done + 1, anchor - width + 1), anchor
                done = high
                here = ranked[bisect_left(ranked, (low,)) : bisect_left(ranked, (high + width,))]
                here = [x for x in here if x[1] in own]
                for j, (start, _) in enumerate(here):
                    if start > high or len(here) - j < need:
                        break
                    first: dict[int, int] = {}
                    for at, r in here[j : j + width]:
                        if at >= start + width:
                            break
                        first.setdefault(r, at)
                    if len(first) >= need:
                        found.append((k, len(first) / len(own), frozenset(first.values())))
        return found

    def line(self, words: list[bytes]) -> list[tuple[int, float, frozenset[int]]]:
        """Number of a template, containment and first places of its words, for each template that a line meets.

        A line longer than the template's ``width`` is no block of it: its windows are.
        """
        met = [(k, score) for k, score in self.met(words) if len(words) <= self.width[k]]
        if not met:
            return []
        first: dict[int, int] = {}
        for at, w in enumerate(words):
            if w in self.rank:
                first.setdefault(self.rank[w], at)
        return [(k, score, frozenset(first[r] for r in self.sets[k] if r in first)) for k, score in met]

    def settled(self, found: list[tuple[int, float, frozenset[int]]]) -> list[tuple[str, float]]:
        """Label and score of matches, without those that a better template has more than half of the same words of, in place:
        the two are variants."""
        rows = sorted((min(places), k, score, places) for k, score, places in found)
        long = max((max(places) - start for start, _, _, places in rows), default=0)
        out: dict[str, float] = {}
        for start, k, score, places in rows:
            if score <= out.get(self.labels[k], 0):
                continue
            # what overlaps starts at most the longest match before this one and not after it
            near = rows[bisect_left(rows, (start - long,)) : bisect_left(rows, (max(places) + 1,))]
            if not any(j != k and more > score and 2 * len(places & others) > len(places) for _, j, more, others in near):
                out[self.labels[k]] = score
        return list(out.items())


def word_frequency(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """In how many places of the corpus each word of the templates stands: as many rows as they have words."""
    vocabulary = frozenset(w for _, t in templates for w in words_of(t))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in filter(vocabulary.__contains__, words_of(text or "")):
                    total[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    index = TemplateIndex(word_frequency(docs, templates), templates, threshold)
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double>")
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            words = words_of(text or "")
            places = phrase_places(words)
            base = {label for _, label in places}
            more: list[tuple[str, float]] = []
            if not index.first.isdisjoint(words):
                for line in text.split("\n"):
                    more += index.settled(index.line(words_of(line)))
                more += index.settled(index.windows(words))
            starts = [at for at, _ in places]
            rows.append(
                {
                    "n_words": len(words),
                    "n_base": len(places),
                    "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)),
                    "labels": ",".join(sorted(base | {label for label, _ in more})),
                    "score": 1.0 if base else max((s for _, s in more), default=0.0),
                }
            )
        return pa.array(rows, kind)

    names = [f.name for f in kind]
    plain = docs.drop(*names, "_found").withColumn("_found", found(F.col("text")))
    return plain.select(*[c for c in plain.columns if c != "_found"], "_found.*")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)
