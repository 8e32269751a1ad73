"""Operator 1: byte-level BPE encoding and decoding.

A vocabulary token is a byte string; mapped to Latin-1 it becomes a key of one Aho-Corasick automaton, which finds in a
single pass the longest token that starts at each byte. Encoding takes these longest matches from left to right. Two
neighbouring tokens are *compatible* if merging their joint bytes by rank gives just these two; a token sequence is the
BPE result exactly if all neighbours are compatible, so the encoder backtracks to the next shorter token (or gives up the
last one) until they are. Compatibility is memoised, dead ends are marked, and each byte is left at most once per token
length, so the time is linear in the piece.

Cases: a null text counts as empty; an empty text has no ids; very long pieces are encoded whole, without recursion; repeated
rows get equal ids; null doc_ids stay; only doc_id and text are read, so other columns may have any name; an empty table stays
empty.
"""

from __future__ import annotations

import base64
import struct
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Cuts up to this many characters are remembered, up to this many in each of two generations, and so many compatible pairs, in each Python worker. They only save time.
MEMO_CHARS, MEMO_PIECES, MEMO_PAIRS = 48, 300_000, 400_000


class _Memo(dict):
    """Packed little-endian ids of cuts seen before; a cut not seen yet is encoded piece by piece.

    When it is full, what it holds becomes the elder generation: of that, only what is met again moves on.
    """

    def __init__(self, codec: ByteBpe):
        self._codec, self._elder = codec, {}

    def __missing__(self, cut: str) -> bytes:
        if self._codec._blank_cuts and cut[-1:] in (".", ",") and cut[-2:-1].isalpha():  # a mark after a letter is a piece of its own
            return self[cut[:-1]] + self[cut[-1]]
        packed = self._elder.get(cut)
        if packed is None:
            packed = self._encoded(cut)
        if len(cut) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self._elder = dict(self)
                self.clear()
            self[cut] = packed
        return packed

    def _encoded(self, cut: str) -> bytes:
        pieces = self._codec.pieces.findall(cut)
        if len(pieces) == 1:
            ids = self._codec.encode_piece(cut.encode("utf-8", "surrogatepass"))
            return struct.pack(f"<{len(ids)}i", *ids)
        return b"".join(map(self.__getitem__, pieces))


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.pieces = regex.compile(pattern)
        # cutting at blanks before the pattern needs what this pattern and vocabulary have: a blank goes with what follows, and
        # no token has one after its first byte
        self._blank_cuts = pattern == public_tokenizers.PATTERN and not any(b" " in token[1:].lstrip(b" ") for token in ranks)
        self._shorter: dict[int, int] = {}
        self._compatible: dict[int, bool] = {}  # by both ids in one number, which takes less room than a pair
        self._memo = _Memo(self)

    @cached_property
    def _automaton(self) -> ahocorasick.Automaton:
        """Built when first used: workers that only decode do without."""
        automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            automaton.add_word(token.decode("latin-1"), (len(token), rank))
        automaton.make_automaton()
        return automaton

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def _merge(self, data: bytes) -> list[int]:
        """Plain merging by lowest rank; only ever run on the bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        known = self._compatible.get(left << 32 | right)
        if known is None:
            data = self.vocabulary[left] + self.vocabulary[right]
            known = data not in self.ranks and self._merge(data) == [left, right]
            if len(self._compatible) > MEMO_PAIRS:
                self._compatible.clear()
            self._compatible[left << 32 | right] = known
        return known

    def _next_shorter(self, token: int) -> int:
        """The longest vocabulary token that is a proper prefix of ``token``; -1 if none."""
        found = self._shorter.get(token)
        if found is None:
            data = self.vocabulary[token]
            found = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self._shorter[token] = found
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        vocabulary, compatible = self.vocabulary, self._compatible
        latin = data.decode("latin-1")
        found = [value for _, value in self._automaton.iter_long(latin)]
        out = [rank for _, rank in found] if sum(n for n, _ in found) == len(data) else []
        for left, right in zip(out, out[1:], strict=False):
            if not (compatible.get(left << 32 | right) or self._fits(left, right)):
                break
        else:  # the longest matches as they stand
            if out:
                return out
        longest: list[int] = [-1] * len(data)
        size = [0] * len(data)
        for end, (length, rank) in self._automaton.iter(latin):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, rank
        out = []
        dead: set[int] = set()  # places from which no compatible rest was found
        at, last, token, total = 0, -1, longest[0], len(data)
        while at < total:
            while token >= 0:
                end = at + len(vocabulary[token])
                if end not in dead:
                    if last < 0:
                        break
                    fits = compatible.get(last << 32 | token)
                    if fits or fits is None and self._fits(last, token):
                        break
                token = self._next_shorter(token)
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < total else -1
            elif out:
                dead.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= len(vocabulary[token])
                token = self._next_shorter(token)
            else:
                raise ValueError("the vocabulary cannot spell this piece")
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text.

        Where the pattern and the vocabulary allow it (checked at load), a single blank between two other characters can only
        start a match, so texts without double blanks are cut there first: the cuts come from fast string splitting and the
        memo then also saves the pattern's work.
        """
        if not text:
            return np.empty(0, "<i4")
        if "  " in text or not self._blank_cuts:
            cuts = self.pieces.findall(text)
        else:
            first, *rest = text.split(" ")
            cuts = ([first] if first else []) + [" " + x for x in rest]
        return np.frombuffer(b"".join(map(self._memo.__getitem__, cuts)), "<i4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe.load(path, pattern)


def encode(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """``array<int>`` ids of a string column under the rank file at ``path`` (a path that every executor has)."""
    path = path or public_tokenizers.path(DEFAULT_RANKS)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        codec = _codec(path, pattern)
        rows = [codec.encode(t.as_py() or "") for t in texts]  # one text at a time: a batch is large enough as it is
        ends = np.zeros(len(rows) + 1, "<i4")
        np.cumsum([len(r) for r in rows], out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, "<i4")))

    return ids(text)


def decode(ids: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes of an ``array<int>`` column; a null array gives empty bytes."""
    path = path or public_tokenizers.path(DEFAULT_RANKS)

    @F.arrow_udf("binary")
    def data(rows: pa.Array) -> pa.Array:
        codec = _codec(path, pattern)
        flat, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
        return pa.array([codec.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return data(F.coalesce(ids, F.array().cast("array<int>")))


def round_trip(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """``struct<ids, decoded>``: what :func:`encode` gives and what :func:`decode` makes of it, in one Python worker."""
    path = path or public_tokenizers.path(DEFAULT_RANKS)

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        codec, parts = _codec(path, pattern), []
        for at in range(0, len(texts), 256):  # small parts: lists of numbers are not kept for a whole batch
            rows = [codec.encode(t.as_py() or "") for t in texts[at : at + 256]]
            ends = np.zeros(len(rows) + 1, "<i4")
            np.cumsum([len(r) for r in rows], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
            decoded = pa.array([codec.decode(r.tolist()) for r in rows], pa.binary())
            parts.append(pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"]))
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return both(text)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.select("doc_id", round_trip(F.col("text")).alias("r"))
    return both.select(
        "doc_id",
        F.size("r.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("r.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("r.decoded", 256).alias("decoded_sha256"),
    )
