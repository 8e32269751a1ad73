"""Operator 7: best-fit packing of tokenized documents into training sequences.

Documents become ids of a public word-piece tokenizer plus a closing id; only those longer than a sequence are cut. The
pieces are dealt into groups of about ``GROUP_DOCS`` documents by a hash, so a group's size does not depend on the data's,
and each group is packed alone: the largest piece opens a bin, the largest pieces that fit fill it, and then *best-two-fit*
tries to replace the bin's smallest piece by the two unpacked pieces that fill the widened gap most tightly. A group wastes
at most one partly filled bin more than packing all at once would.

Cases: a null or empty text is just the closing id; repeated rows are packed once each and, as rows of one id are, spread over
the groups; pieces of equal length are taken by doc_id and piece; a null doc_id is an id like any other; very long texts are cut
into pieces; an empty table gives no rows; only the id and text columns are used, others may have any name.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import release, table

SEQUENCE, END_ID, GROUP_DOCS = 2048, 0, 8192
DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Words up to this many characters are remembered, up to this many in each of two generations in each Python worker. Both only save time.
MEMO_CHARS, MEMO_WORDS = 48, 200_000


class WordIds(dict):
    """Packed little-endian ids by word. No token of this tokenizer spans white space, so a text's ids are its words' ids; the
    vocabulary's added tokens, which stand for themselves wherever their text does, have no white space either."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._elder: dict[str, bytes] = {}  # what the memo held when it was last full; what is met again moves on
        self._tokenizer = Tokenizer.from_file(path)
        self._merges = self._tokenizer.model.tokenize
        # other letters may become several characters when lowered
        self._ends_plain = re.compile("[A-Za-z0-9À-ÖØ-öø-ÿ]").match
        self._odd_mark = re.compile("(?:^|[^A-Za-z0-9À-ÖØ-öø-ÿ])[.,] ").search
        self._plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        # bytes 0x80-0xFF as the letters that stand for them in a byte-level vocabulary
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self._letters = {b: 256 + i for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        packed = self._elder.get(word)
        if packed is None:
            packed = self._encoded(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self._elder = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def _encoded(self, word: str) -> bytes:
        if word[-1:] in (".", ",") and self._ends_plain(word, len(word) - 2):  # a mark after a letter or digit is a token of its own
            return self[word[:-1]] + self[word[-1]]
        if self._plain(word):  # one letter run that normalisation only lowers: it goes to the merges as it is
            tokens = self._merges(word.lower() if word.isascii() else word.lower().encode().decode("latin-1").translate(self._letters))
            return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        ids = self._tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str) -> bytes:
        text = text.replace("\n", " ") + " "
        if not self._odd_mark(text):  # all marks follow a letter or digit: they are words of their own, and the memo holds words without them
            text = text.replace(". ", " . ").replace(", ", " , ")
        return b"".join(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, copy[, ids])``: the pieces of each document's ids, in order.

    ``copy`` tells rows of one id and text apart: it is the task and how many such rows it had before. Equal rows may change
    places, so a task that is repeated gives the same rows.
    """
    path = path or public_tokenizers.path(DEFAULT_TOKENIZER)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, seen = _word_ids(path), struct.pack("<I", END_ID), Counter()
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time: a batch is large enough as it is
                doc_id, data = doc_id.as_py(), ids_of.text(text.as_py() or "") + end
                same = hash((doc_id, zlib.crc32(data)))
                copy, seen[same] = task + seen[same], seen[same] + 1
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), copy, np.frombuffer(part, "<i4") if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "copy", "ids"][: 6 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names)
            release()

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def best_two_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place in the bin for each length; every length is from 1 to ``size``."""
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    present = sorted(stacks)
    bins, offsets = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")

    def take(length: int) -> int:
        stack = stacks[length]
        item = stack.pop()
        if not stack:
            del present[bisect_right(present, length) - 1]
        return item

    def give_back(length: int, item: int) -> None:
        if not stacks[length]:
            insort(present, length)
        stacks[length].append(item)

    def closest_pair(gap: int, above: int) -> tuple[int, int] | None:
        """The two unpacked lengths with the largest sum from above + 1 to gap."""
        best, pair = above, None
        for k in range(bisect_right(present, gap) - 1, -1, -1):
            one = present[k]
            if 2 * one <= best:
                break
            j = min(bisect_right(present, gap - one) - 1, k)
            if j == k and len(stacks[one]) < 2:
                j -= 1
            if j >= 0 and one + present[j] > best:
                best, pair = one + present[j], (one, present[j])
                if best == gap:
                    break
        return pair

    number = 0
    while present:
        inside: list[tuple[int, int]] = []
        gap = size
        while (k := bisect_right(present, gap) - 1) >= 0:
            length = present[k]
            inside.append((length, take(length)))
            gap -= length
        if gap and len(inside) > 1 and present:
            length, item = inside[-1]  # filled from large to small
            if pair := closest_pair(gap + length, length):
                inside.pop()
                inside += [(x, take(x)) for x in pair]
                give_back(length, item)
        at = 0
        for length, item in inside:
            bins[item], offsets[item] = number, at
            at += length
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, groups: int, size: int = SEQUENCE) -> DataFrame:
    """``pieces`` as :func:`token_pieces` gives them with ``sequence_id`` and ``offset``, packed in ``groups`` groups; ``copy`` goes."""
    kept = [f for f in pieces.schema.fields if f.name != "copy"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    names = [f.name for f in kept]

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable", na_position="first", ignore_index=True)
        bins, offsets = best_two_fit(rows["length"].to_numpy(), size)
        return rows[names].assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    grouped = pieces.select(*names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(groups)).alias("_group"))
    return grouped.groupBy("_group").applyInPandas(packed, schema)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Tokenize and pack ``docs``: one row per piece with its sequence and place."""
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    return pack(token_pieces(docs, path, size), groups, size)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
