"""Ingest: files in, a new state of the knowledge base out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import chunking
from folio.operators.changes import classify
from folio.operators.keyword import TASK_BYTES, bucket_of, dealt_index
from folio.operators.marks import marked, marks, numbered_once
from folio.operators.metadata import automatic, upsert
from folio.operators.ranking import bounded
from folio.operators.vector import check_dimension, embed_chunks, hashed_embedder
from folio.sources.files import Extractor, described, extract, raw_rows, read_files
from folio.sources.log import ConflictError, Folder
from folio.sources.store import COMPRESSION, NUMBERS, Store


@dataclass(frozen=True)
class Options:
    size: int = chunking.SIZE
    overlap: int = chunking.OVERLAP
    force: bool = False
    no_raw: bool = False
    batch: int = 16
    embed: Callable[[list[str]], np.ndarray] = field(default_factory=hashed_embedder)
    extractors: dict[str, Extractor] = field(default_factory=dict)


#: Times an ingest starts again because another writer was there first.
ATTEMPTS = 5


#: Rows, and bytes, that a Python worker gets at once: files are large rows, and Spark's 10,000 of them may be gigabytes.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


@contextmanager
def settings(wanted: dict[str, object], *sessions: SparkSession) -> Iterator[None]:
    """Settings of ``sessions`` for a while; what was set before comes back."""
    before = [(s, {k: s.conf.get(k, None) for k in wanted}) for s in sessions]
    try:
        for s in sessions:
            for k, v in wanted.items():
                s.conf.set(k, str(v))
        yield
    finally:
        for s, old in reversed(before):
            for k, v in old.items():
                s.conf.unset(k) if v is None else s.conf.set(k, v)


def small_batches(*sessions: SparkSession):
    """Small batches for Python workers while an ingest runs."""
    return settings({"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}, *sessions)


def _attempts(work: Callable[[], DataFrame]) -> DataFrame:
    for left in range(ATTEMPTS - 1, -1, -1):
        try:
            return work()
        except ConflictError:
            if not left:
                raise
    raise AssertionError


def ingest(store: Store, files: DataFrame, options: Options = Options(), run: tuple[str, int] | None = None) -> DataFrame:
    """Bring ``files(path, length, content, ...)`` into ``store``; returns ``path, status, chunks, error``.

    Unchanged files are skipped by their hash, so running again is safe. A file that fails keeps its old chunks and its old
    hash, and is tried again next time. Files are read once; of the store only the buckets of their paths, and of their digests,
    are read, and a segment is added to those of what is new. If another writer has changed the same meanwhile, all is done again
    from the new state. ``run``, the name of a stream and the number of its batch, is committed with the state.
    """
    chunking.validate(options.size, options.overlap)
    with small_batches(store.spark, files.sparkSession):  # a stream's files have a session of their own
        out = _attempts(lambda: _ingest(store, files, options, run))
    store.merge()
    return out


def _ingest(store: Store, files: DataFrame, options: Options, run: tuple[str, int] | None) -> DataFrame:
    spark, state, generation = store.spark, store.state(), uuid.uuid4()
    gen = F.lit(generation.int >> 65).alias("gen")

    scratch, names = f"scratch/{generation.hex}", []

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = f"{store.folder}/{scratch}/{name}"
        rows.write.option("compression", COMPRESSION).parquet(path)
        names.append(name)
        return spark.read.schema(rows.schema).parquet(path)

    def set_of(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        found = kept(marks(rows), name)
        return found, found.count()

    def swept() -> None:
        """Of what was kept on the way only the result stays."""
        files = Folder(spark, store.folder)
        for name in names:
            if name != "result":
                files.delete(f"{scratch}/{name}")

    # what changes, and whose text is whose, is found in the short columns; contents and texts stay where they are
    files = kept(described(files).select("path", "content", "sha256", "title", "mime_type", "error", numbered_once()), "files")
    # one bucket of documents for a path
    places = store.buckets_of("documents", files)
    documents = store.read("documents", places, state, stored=True)
    seen = kept(classify(files.drop("content"), documents, options.force), "seen")
    skipped = seen.where("change = 'unchanged'").select("path", F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("chunks"), F.lit(None).cast("string").alias("error"))
    todo = seen.where("change != 'unchanged'")
    odd = F.col("document_id") != F.xxhash64("path")
    n_todo, n_good, n_odd = todo.agg(F.count("*"), F.count_if(F.col("error").isNull()), F.count_if(odd)).first()
    if not n_todo:
        report = kept(skipped, "result")
        if run:
            store.commit(state, run=run)
        swept()
        return report
    good, filled = todo.where("error IS NULL"), todo.where("error IS NULL AND sha256 IS NOT NULL")
    keys, raw_keys = ["sha256", "mime_type"], ["sha256", "ext"]
    known = store.contents("extracted", filled, keys, n_good, state).select(*keys).distinct().withColumn("known", F.lit(True))
    firsts = kept(filled.groupBy(*keys).agg(F.min("row").alias("row"), F.count("*").alias("n")).join(known, keys, "left"), "firsts")
    n_known, n_new, n_shared = firsts.agg(F.count("known"), F.count_if(F.col("known").isNull()), F.count_if(F.col("known").isNull() & (F.col("n") > 1))).first()
    # only contents that the store has no text of are extracted, once for each MIME type they are seen as, and by the file that has them first
    new = set_of(firsts.where("known IS NULL"), "new")
    contents = marked(files, *new)
    if n_odd:
        contents = contents.join(bounded(todo.where(odd).select("row", "document_id"), n_odd), "row", "left")
    document_id = F.coalesce("document_id", F.xxhash64("path")) if n_odd else F.xxhash64("path")
    fresh = extract(contents.withColumn("document_id", document_id), options.extractors).select(*keys, "text", "error", "row", "document_id")
    extracted, fresh = store.laid("extracted", fresh, F.col("error").isNotNull())
    problems = fresh.where("error IS NOT NULL").select(*keys, F.col("error").alias("problem"))
    n_problems = problems.count()
    texts = fresh.where("error IS NULL").select("document_id", "text")
    if n_good > n_new:
        # the others have the text of the first, or of the store
        again = marked(fresh, *set_of(firsts.where("known IS NULL AND n > 1"), "shared")) if n_shared else fresh.where("false")
        there = store.contents("extracted", firsts.where("known"), keys, n_known, state).select(*keys, "text").unionByName(again.where("error IS NULL").select(*keys, "text"))
        others = marked(good, *new, inside=False).select("document_id", *keys).join(there, keys, "left")
        texts = texts.unionByName(kept(others.select("document_id", "text"), "others"))
    chunks = chunking.chunk_documents(texts, options.size, options.overlap)
    made, embedded = store.laid("chunks", embed_chunks(chunks, options.embed, options.batch).select("*", gen))
    failed = embedded.where("error IS NOT NULL").groupBy("document_id").agg(F.min("error").alias("failure"))
    n_failed = failed.count()
    tried = todo
    if n_problems:
        tried = tried.join(bounded(problems, n_problems), keys, "left").withColumn("error", F.coalesce("error", "problem")).drop("problem")
    if n_failed:
        failed = kept(failed, "failed")
        tried = tried.join(bounded(failed, n_failed), "document_id", "left").withColumn("error", F.coalesce("error", "failure")).drop("failure")
        whole = embedded.drop("error", "bucket").join(bounded(failed, n_failed), "document_id", "left_anti")
        made, embedded = store.laid("chunks", whole)
    if n_problems or n_failed:
        tried = kept(tried, "tried")
    done = tried.where("error IS NULL")
    # the dimension is known from the runs before; only where it changes are all chunks looked at
    dimension = check_dimension(embedded)
    if dimension is not None and state["facts"].get("dimension") not in (None, str(dimension)):
        check_dimension(store.read("chunks", state=state), dimension, done)
    with settings({"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES}, spark):
        indexed, postings = store.laid("postings", dealt_index(embedded, store.buckets).select("*", gen))
    # what a document has is counted before it is written, and goes with it
    counts = embedded.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("text")).alias("chars"), F.count("embedding").alias("embedded"))
    words = postings.where("term = ''").where(F.col("bucket") == bucket_of(F.lit(""), store.buckets)).groupBy("document_id").agg(F.sum("dl").alias("words"))
    old = documents.join(done.select("document_id"), "document_id", "left_semi")
    was = old.select("document_id", F.col("created_at").alias("was"), F.col("title").alias("had"))
    now = F.date_trunc("second", F.current_timestamp())
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = done.join(was, "document_id", "left").join(counts, "document_id", "left").join(words, "document_id", "left")
    rows = rows.select("document_id", "path", "sha256", F.coalesce("had", "title").alias("title"), "mime_type", F.coalesce("was", now).alias("created_at"), now.alias("updated_at"), gen, *map(count, NUMBERS))
    settled, rows = store.laid("documents", store.dealt("documents", rows))
    result = tried.join(rows.select("document_id", "chunks"), "document_id", "left")
    error = F.col("error")
    result = result.select("path", F.when(error.isNull(), "ingested").otherwise("error").alias("status"), F.when(error.isNull(), F.coalesce("chunks", F.lit(0))).otherwise(0).cast("long").alias("chunks"), "error")
    report = kept(result.unionByName(skipped), "result")
    places_of_metadata = store.buckets_of("metadata", done)
    before = store.read("metadata", places_of_metadata, state).join(done.select("document_id"), "document_id", "left_semi")
    archived = raw_rows(filled)
    held = store.contents("raw", archived, raw_keys, n_good, state).select(*raw_keys)
    # one file of each content that is not there yet
    lacking = archived.groupBy(*raw_keys).agg(F.min("row").alias("row")).join(held, raw_keys, "left_anti")
    work = {
        "metadata": lambda: store.written("metadata", upsert(before, automatic(done.select("document_id", "path"))).select("*", gen)),
        "raw": lambda: {} if options.no_raw else store.laid("raw", raw_rows(marked(files, *set_of(lacking, "lacking"))).drop("row"))[0],
        "gone": lambda: store.written("gone", old.select("document_id", "gen", *NUMBERS)),
    }
    # independent jobs, which the cluster runs side by side
    with ThreadPoolExecutor(len(work)) as pool:
        add = dict(zip(work, pool.map(lambda f: f(), work.values()), strict=True))
    add |= {"chunks": made, "postings": indexed, "extracted": extracted, "documents": settled}
    touched = {"documents": places, "metadata": places_of_metadata, "extracted": store.buckets_of("extracted", filled)}
    store.commit(state, add, touched=touched, facts={"dimension": str(dimension)} if dimension is not None else None, run=run)
    swept()
    return report


def remove(store: Store, paths: DataFrame) -> DataFrame:
    """Delete the documents of ``paths(path)`` from ``store`` with all that belongs to them; ``path, status, chunks``.

    The documents' rows say what they take away: they alone are read, and noted as gone. Nothing is rewritten, and a text is
    there no longer when no document has it.
    """
    return _attempts(lambda: _remove(store, paths))


def _remove(store: Store, paths: DataFrame) -> DataFrame:
    state, asked = store.state(), paths.select("path").distinct()
    places = store.buckets_of("documents", asked)
    gone = store.read("documents", places, state, stored=True).join(asked, "path", "left_semi")
    status = F.when(F.col("document_id").isNull(), "not found").otherwise("deleted")
    report = asked.join(gone.select("path", "document_id", "chunks"), "path", "left").select("path", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    place = f"{store.folder}/scratch/{uuid.uuid4().hex}"
    report.write.parquet(place)
    add = store.written("gone", gone.select("document_id", "gen", *NUMBERS))
    if add:
        store.commit(state, {"gone": add}, touched={"documents": places})
    return store.spark.read.schema(report.schema).parquet(place)


def update(store: Store, path: str, options: Options = Options()) -> DataFrame:
    """Ingest one file again if it has changed; a folder, or a path that is no file of a known kind, is refused."""
    found = read_files(store.spark, path)
    place = found.select("path").limit(2).collect()
    if len(place) != 1 or place[0]["path"].rsplit("/", 1)[-1] != path.rstrip("/").rsplit("/", 1)[-1]:
        raise ValueError(f"{path} is not one file")
    return ingest(store, found, options)


def summary(results: DataFrame) -> DataFrame:
    """``status, n`` of an ingest's results."""
    return results.groupBy("status").agg(F.count("*").alias("n"))
