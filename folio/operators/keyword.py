"""Inverted index and BM25 keyword search with phrases, for many queries at once."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators.metadata import restricted
from folio.operators.ranking import bounded, effective_k, hydrated, top
from folio.sources.scratch import scratch_folder

#: Constants of BM25 and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Distinct query terms up to this many are a filter of the scan of the postings.
MOST_TERMS = 4096
_MARKS, _RARE = regex.compile(r"\p{M}+"), regex.compile(r"[\p{M}\p{Co}]")
_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_WORD = re.compile(r"[^\W_]+")
#: Letters, digits, and characters of private use.
_ANY_WORD = regex.compile(r"[\p{L}\p{N}\p{Co}]+")
#: Folded words up to this many are remembered in each Python worker; that only saves time.
_MEMO, MOST_MEMO = {}, 200_000


def fold(text: str) -> str:
    """Lower case without diacritics."""
    text = text.lower()
    if text.isascii():
        return text
    return _MARKS.sub("", unicodedata.normalize("NFD", text))


def words(text: str) -> list[str]:
    """Runs of letters, digits and characters of private use of the folded text.

    Where no mark stands by itself, words are the same before folding, so each word is folded once.
    """
    text = text.lower()
    if text.isascii():
        return _WORD.findall(text)
    if _RARE.search(text):
        return _ANY_WORD.findall(_MARKS.sub("", unicodedata.normalize("NFD", text)))
    if len(_MEMO) > MOST_MEMO:
        _MEMO.clear()
    out = []
    for word in _WORD.findall(text):
        folded = _MEMO.get(word)
        if folded is None:
            folded = _MEMO[word] = word if word.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", word))
        out.append(folded)
    return out


def query_phrases(text: str) -> list[list[str]]:
    """Each white-space term of a query is a phrase of its words; terms without words are dropped, operators are plain."""
    return [p for p in map(words, _BLANK.split(text)) if p]


POSTINGS = "term string, chunk_id long, document_id long, positions array<int>, dl int"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of ``(chunk_id, document_id, text)`` rows, some rows at a time: their words are sorted as numbers by row and term."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [words(t.as_py() or "") for t in part.column(2)]
            lengths = np.array([len(f) for f in found], "int64")
            row, start = np.repeat(np.arange(len(found)), lengths), np.cumsum(lengths) - lengths
            coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[order], prepend=-1))
            positions = (np.arange(len(key)) - start[row])[order].astype("int32")
            terms = pc.take(coded.dictionary, coded.indices.take(pa.array(order[new])))
            rows = row[order[new]]
            # and of every chunk one posting of the empty term, which no query has: it carries the length
            rows, terms = np.concatenate([rows, np.arange(len(found))]), pa.concat_arrays([terms, pa.array([""] * len(found), pa.string())])
            ends = np.concatenate([new, np.full(len(found) + 1, len(key))]).astype("int32")
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([terms, part.column(0).take(take), part.column(1).take(take), pa.ListArray.from_arrays(pa.array(ends), pa.array(positions)), pa.array(lengths[rows].astype("int32"))], ["term", "chunk_id", "document_id", "positions", "dl"])


def build_index(chunks: DataFrame) -> DataFrame:
    """Postings ``(term, chunk_id, document_id, positions, dl)``. A chunk is one row, so nothing is shuffled.

    Each chunk also has one posting of the empty term, so that it counts as a chunk whatever its text.
    """
    return chunks.select("chunk_id", "document_id", "text").mapInArrow(_postings, POSTINGS)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: Chunks, and bytes of their text, whose postings move as one block a bucket; bytes of blocks that a task sorts and writes: some twenty times that as rows.
BLOCK_ROWS, BLOCK_BYTES, TASK_BYTES = 2048, 8 << 20, 6 << 20
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")

#: Hashes of words up to as many as are folded, in each Python worker; that only saves time.
_HASHED: dict[str, int] = {}


def _bucket(term: str, buckets: int) -> int:
    found = _HASHED.get(term)
    if found is None:
        if len(_HASHED) > MOST_MEMO:
            _HASHED.clear()
        found = _HASHED[term] = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42)
    # as Spark's: signed, then its remainder
    return (found - (found >> 63 << 64)) % buckets


def _bytes_apart(numbers: np.ndarray) -> pa.Array:
    """The bytes of 32-bit numbers, first all lowest, so that those which are nearly always 0 compress to nothing."""
    return pa.array(np.ascontiguousarray(numbers.astype("<i4").view("u1").reshape(-1, 4).T).ravel())


def _bytes_joined(parts: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(parts.to_numpy().reshape(4, -1).T).view("<i4").ravel()


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to the rows and bytes of a block, or as they are if they are larger."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows > BLOCK_ROWS or sum(b.nbytes for b in held) + batch.nbytes > BLOCK_BYTES):
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _packed(rows: pa.Table, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Postings as a block a bucket, by term and chunk; ids and lengths are there once a chunk, numbers are differences, and all is compressed."""
    coded = rows.column("term").combine_chunks().dictionary_encode()
    of_term = np.array([_bucket(t, buckets) for t in coded.dictionary.to_pylist()], "int64")
    codes = coded.indices.to_numpy()
    ids, places = np.unique(rows.column("chunk_id").to_numpy(), return_inverse=True)
    turn = np.argsort(np.argsort(of_term, kind="stable"))
    order = np.argsort(turn[codes] * len(ids) + places, kind="stable")
    starts = np.searchsorted(of_term[codes[order]], np.arange(buckets + 1))
    for bucket in range(buckets):
        take = order[starts[bucket] : starts[bucket + 1]]
        if not len(take):
            continue
        part = rows.take(pa.array(take))
        new = np.flatnonzero(np.diff(codes[take], prepend=-1))
        positions = part.column("positions").combine_chunks()
        chunk, first, place = np.unique(places[take], return_index=True, return_inverse=True)
        flat, times = positions.flatten().to_numpy(), pc.list_value_length(positions).to_numpy()
        # a position as its distance from the one before of its posting, a chunk from the one before of its term
        apart, step = np.diff(flat, prepend=0), np.diff(place, prepend=0)
        heads = (np.cumsum(times) - times)[times > 0]
        apart[heads], step[new] = flat[heads], place[new]
        columns = {
            "term": coded.dictionary.take(pa.array(codes[take][new])),
            "n": _bytes_apart(np.diff(np.append(new, len(take)))),
            "step": _bytes_apart(step),
            "times": _bytes_apart(times),
            "apart": _bytes_apart(apart),
            "chunk_id": pa.array(ids[chunk]),
            "document_id": part.column("document_id").combine_chunks().take(pa.array(first)),
            "dl": part.column("dl").combine_chunks().take(pa.array(first)),
        }
        row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()], list(columns))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, row.schema, options=_ZSTD) as out:
            out.write_batch(row)
        yield bucket, sink.getvalue().to_pybytes()


def _sums(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of ``steps`` from the start of each run of these ``lengths``."""
    total = np.concatenate([[0], np.cumsum(steps, dtype="int64")])
    return total[1:] - np.repeat(total[np.cumsum(lengths, dtype="int64") - lengths], lengths)


def _unpacked(block: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(block) as source:
        row = source.read_next_batch()
    c = {name: row.column(i).flatten() for i, name in enumerate(row.schema.names)}
    n, step, times, apart = (_bytes_joined(c[k]) for k in ("n", "step", "times", "apart"))
    ends = np.concatenate([[0], np.cumsum(times, dtype="int64")])
    flat, at = _sums(apart, times), pa.array(_sums(step, n))
    terms = c["term"].take(pa.array(np.repeat(np.arange(len(n)), n)))
    positions = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(flat.astype("int32")))
    return pa.RecordBatch.from_arrays([terms, c["chunk_id"].take(at), c["document_id"].take(at), positions, c["dl"].take(at)], ["term", "chunk_id", "document_id", "positions", "dl"])


def dealt_index(chunks: DataFrame, buckets: int) -> DataFrame:
    """The postings of :func:`build_index`, dealt by the bucket of their term: the rows of a task are of few buckets.

    They move as compressed blocks, of some thousand chunks and a bucket each, since as rows they are several times the text.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _some(batches):
            found = list(_postings(iter([some])))
            if not found:
                continue
            for bucket, block in _packed(pa.Table.from_batches(found), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.binary())], ["bucket", "block"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield _unpacked(block.as_py())

    blocks = chunks.select("chunk_id", "document_id", "text").mapInArrow(packed, "bucket int, block binary")
    return blocks.hint("rebalance", "bucket").select("block").mapInArrow(rows, POSTINGS)


@dataclass(frozen=True)
class StoredIndex:
    """A written index: postings in folders by a hash of their term and sorted within, and what is counted over all of them."""

    postings: DataFrame
    buckets: int
    chunks: int
    words: int


@dataclass(frozen=True)
class Texts:
    """Chunks ``(chunk_id, document_id, text)`` that are searched without an index: they are scanned for all queries at once."""

    chunks: DataFrame


def write_index(index: DataFrame, folder: str, buckets: int = 64) -> None:
    """Write postings below ``folder``. Searches read the folders of their terms alone, and of those the row groups.

    Postings are dealt by bucket and then balanced by size, so that a frequent term is written by several tasks.
    """
    spark = index.sparkSession
    dealt = index.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
    size = corpus_statistics(spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{folder}/postings").where(F.col("bucket") == bucket_of(F.lit(""), buckets)))
    size.select(F.lit(buckets).alias("buckets"), "chunks", "words").coalesce(1).write.parquet(f"{folder}/size")


def read_index(spark: SparkSession, folder: str) -> StoredIndex:
    size = spark.read.schema("buckets int, chunks long, words long").parquet(f"{folder}/size").first()
    return StoredIndex(spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{folder}/postings"), size["buckets"], size["chunks"], size["words"])


def stored(index: DataFrame | StoredIndex) -> StoredIndex:
    """An index as it is searched; one that is not written is written first, for it is read several times."""
    if isinstance(index, StoredIndex):
        return index
    folder = scratch_folder(index.sparkSession, "index")
    write_index(index, folder, 16)
    return read_index(index.sparkSession, folder)


def term_statistics(index: DataFrame) -> DataFrame:
    """``term, df, cf``: chunks that have a term, and its occurrences."""
    return index.where("term != ''").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"))


def corpus_statistics(index: DataFrame) -> DataFrame:
    """One row ``chunks, words``, from the postings of the empty term."""
    return index.where("term = ''").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))


def phrases_of(queries: DataFrame) -> DataFrame:
    """``query_id, n_phrases, phrase, key, length, place, term`` of ``queries(query_id, text)``; equal phrases have one ``key``."""

    @F.arrow_udf("array<array<string>>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([query_phrases(t or "") for t in texts.to_pylist()], pa.list_(pa.list_(pa.string())))

    rows = queries.select("query_id", split("text").alias("ps"))
    rows = rows.select("query_id", F.size("ps").alias("n_phrases"), F.posexplode("ps").alias("phrase", "terms"))
    return rows.select("query_id", "n_phrases", "phrase", F.array_join("terms", " ").alias("key"), F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))


def _kept(rows: DataFrame, folder: str, name: str) -> DataFrame:
    rows.write.parquet(f"{folder}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")


def postings_of(index: StoredIndex, asked: DataFrame) -> DataFrame:
    """The postings of the terms of ``asked(term, ...)`` and perhaps others: few terms, and their buckets, are filters of the scan."""
    terms = asked.select("term", bucket_of(F.col("term"), index.buckets).alias("bucket")).distinct().limit(MOST_TERMS + 1).collect()
    if len(terms) > MOST_TERMS:
        return index.postings.drop("bucket")
    here = F.col("bucket").isin(sorted({r["bucket"] for r in terms})) & F.col("term").isin(sorted(r["term"] for r in terms))
    return index.postings.where(here).drop("bucket")


def _looked_up(rows: DataFrame, wanted: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``rows`` joined with what is ``wanted`` of them, at most ``most`` rows: while these are few the larger side stays where it is."""
    return rows.join(bounded(wanted, most), keys)


def phrase_hits(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, chunk_id, document_id, dl, f``: chunks with a phrase of several words and how often they have it.

    Only chunks with the rarest word of a phrase are looked at: the postings of the other words are looked up for them, by term
    and chunk, and nothing else moves. A word's positions, less its place in the phrase, are where the phrase may start; the
    starts that all words share count.
    """
    several = asked.where("length > 1").select("key", "length", "place", "term", "df").distinct()
    seeds = several.groupBy("key", "length").agg(F.min_by("term", F.struct("df", "place")).alias("term"), F.min("df").alias("df"), F.count("df").alias("there"))
    seeds = seeds.where("there = length")  # a phrase with a word that nobody has is nowhere
    n_seeds, n_found, n_wanted = seeds.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum(F.col("df") * F.col("length")), F.lit(0))).first()
    found = _looked_up(rows.select("term", "chunk_id"), seeds.select("key", "term"), ["term"], n_seeds).select("key", "chunk_id")
    wanted = several.select("key", "length", "place", "term").join(bounded(found, n_found), "key")
    met = _looked_up(rows, wanted, ["term", "chunk_id"], n_wanted)
    starts = F.transform("positions", lambda p: p - F.col("place")).alias("starts")
    all_of = met.select("key", "length", "chunk_id", "document_id", "dl", starts).groupBy("key", "length", "chunk_id").agg(F.first("document_id").alias("document_id"), F.first("dl").alias("dl"), F.collect_list("starts").alias("all"))
    shared = F.aggregate(F.slice("all", 2, F.col("length")), F.get("all", F.lit(0)), lambda acc, s: F.array_intersect(acc, s))
    f = F.when(F.size("all") == F.col("length"), F.size(shared)).otherwise(0)
    return all_of.select("key", "chunk_id", "document_id", "dl", f.alias("f")).where("f > 0")


def scored(index: DataFrame | StoredIndex, queries: DataFrame) -> DataFrame:
    """``query_id, chunk_id, document_id, score`` of the chunks that hold all phrases of a query.

    Phrases of several words are found first. Then each query starts with its rarest phrase, and its others are looked up in the
    chunks that have that one. A phrase's frequency is of the whole index, so all its chunks are found, whatever the score.
    """
    index = stored(index)
    average = index.words / max(1, index.chunks)
    folder = scratch_folder(queries.sparkSession, "search")
    asked = _kept(phrases_of(queries), folder, "asked")
    rows = postings_of(index, asked)
    # frequencies are counted where the postings are; a row a term moves
    asked = _kept(asked.join(rows.groupBy("term").agg(F.count("*").alias("df")).join(asked.select("term").distinct(), "term"), "term", "left"), folder, "terms")
    hits = _kept(phrase_hits(rows, asked), folder, "hits")
    often = hits.groupBy("key").agg(F.count("*").alias("n"))
    units = asked.where("place = 0").join(often, "key", "left").withColumn("df", F.when(F.col("length") == 1, F.col("df")).otherwise(F.col("n")))
    units = units.where("df > 0").select("query_id", "n_phrases", "phrase", "key", "length", "df")
    # queries all of whose phrases are somewhere
    whole = Window.partitionBy("query_id")
    units = units.withColumn("there", F.count("*").over(whole)).where("there = n_phrases").withColumn("first", F.row_number().over(whole.orderBy("df", "phrase")) == 1)
    units = _kept(units.drop("there"), folder, "units")
    n_units, n_first, n_all = units.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("first"), F.col("df"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("first"), F.col("df") * F.col("n_phrases"))), F.lit(0))).first()
    start = units.where("first").select("query_id", "key", "length")
    words_of = rows.select(F.col("term").alias("key"), "chunk_id", "document_id", "dl", F.size("positions").alias("f"))
    one, several = F.col("length") == 1, F.col("length") > 1
    chunks = lambda source, kind: _looked_up(source.select("key", "chunk_id"), start.where(kind), ["key"], n_units).select("query_id", "chunk_id")
    candidates = chunks(words_of, one).unionByName(chunks(hits, several))
    wanted = units.select("query_id", "n_phrases", "key", "length", "df").join(bounded(candidates, n_first), "query_id")
    part_of = lambda source, kind: _looked_up(source, wanted.where(kind), ["key", "chunk_id"], n_all)
    met = part_of(words_of, one).unionByName(part_of(hits, several), allowMissingColumns=True)
    n = F.col("df").cast("double")
    idf = F.greatest(F.log((F.lit(float(index.chunks)) - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
    f, dl = F.col("f").cast("double"), F.col("dl").cast("double")
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / (average or 1.0)))
    # parts are added in any order: what is left of that is rounded away, so that equal chunks are ties
    score = F.round(F.sum(part), 9).alias("score")
    all_of = met.groupBy("query_id", "chunk_id", "n_phrases").agg(F.first("document_id").alias("document_id"), F.count("*").alias("met"), score)
    return all_of.where("met = n_phrases").select("query_id", "chunk_id", "document_id", "score")


def keyword_ranks(index: DataFrame | StoredIndex | Texts, queries: DataFrame, k: int, metadata: DataFrame | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """``query_id, rank, chunk_id, document_id, score``; frequencies are of the whole index, filtered or not."""
    if isinstance(index, Texts):
        from folio.operators.scan import scanned_ranks

        return scanned_ranks(index.chunks, queries, k, metadata, filters)
    return top(restricted(scored(index, queries), metadata, filters), k)


def keyword_search(index: DataFrame | StoredIndex | Texts, chunks: DataFrame, documents: DataFrame, queries: DataFrame, top_k: int = 5, metadata: DataFrame | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """The ``top_k`` chunks of each query with text, path and title. There is no least score here."""
    k = effective_k(top_k)
    return hydrated(keyword_ranks(index, queries, k, metadata, filters), chunks, documents, "keyword", k * queries.count())
