"""A knowledge base as Parquet segments: what is written is never changed, and a log of commits says what is current.

Every table is dealt into buckets, by what it is looked up by: documents by a hash of their path, chunks and metadata by their
document, postings by a hash of their term, texts and raw copies by their digest. An ingest adds a segment to the buckets it
concerns and reads no other bucket. A document's rows carry the generation of the ingest that wrote them; what an ingest or a
removal supersedes is noted, a row a document, in the table ``gone``, and is left out when tables are read. A text is there
while a document has it. ``merge`` joins segments of like size, so that there stay few, and ``compact`` also drops what is gone;
both also join the files that the tasks of a large ingest have each written for a bucket.

The log has statistics of each part, and ``gone`` those of what it takes away, so that the numbers of a knowledge base, and the
sizes that decide about broadcasts, are sums of a few lines.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators.keyword import StoredIndex, bucket_of
from folio.operators.ranking import bounded
from folio.schemas import TABLES
from folio.sources.log import ConflictError, Folder, Log

BUCKETS = 64
#: The bucket of rows that are in no part, and how segments are compressed.
ASIDE, COMPRESSION = -1, "zstd"
#: Segments of one bucket and of like size that are joined.
FANOUT = 8
#: Tables whose rows belong to a generation of a document; the others are of contents by their digest.
OWNED = ("documents", "chunks", "metadata", "postings")
NUMBERS = ("chunks", "chars", "embedded", "words")
_LONGS = [T.StructField(n, T.LongType()) for n in ("gen", *NUMBERS)]
GONE = T.StructType([T.StructField("document_id", T.LongType()), *_LONGS])
#: Documents are kept with the numbers of what belongs to them, so that a removal need look at nothing else.
SCHEMAS = {name: T.StructType([*schema, *(_LONGS if name == "documents" else _LONGS[:1] if name in OWNED else [])]) for name, schema in TABLES.items()} | {"gone": GONE}
#: By what rows are sorted within a bucket: lookups then skip most of a file.
ORDER = {"documents": "path", "chunks": "document_id", "metadata": "document_id", "postings": "term", "extracted": "sha256", "raw": "sha256", "gone": "document_id"}
#: Statistics of a part, beside its rows.
COUNTED = {
    "chunks": {"chars": "coalesce(sum(char_length(text)), 0)", "embedded": "count(embedding)"},
    "postings": {"chunks": "count_if(term = '')", "words": "coalesce(sum(if(term = '', dl, null)), 0)"},
    "gone": {n: f"coalesce(sum({n}), 0)" for n in NUMBERS},
}


class Store:
    """The tables below one folder, by any path that Spark can open."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._log = Log(spark, f"{self.folder}/log")
        self.buckets = int(self.fact("buckets") or buckets)

    def state(self) -> dict:
        """Current parts, facts and runs: a line a part, not a line a document."""
        return self._log.state()

    def number(self) -> int:
        return self.state()["version"]

    def fact(self, name: str) -> str | None:
        """A fact of the whole store, such as the dimension of its embeddings."""
        return self.state()["facts"].get(name)

    def last_run(self, name: str) -> int | None:
        """The number of the last run of a stream that was committed."""
        return self.state()["runs"].get(name)

    def bucket(self, name: str) -> Column:
        """The bucket of a row. A document's id is by default the hash of its path, so the buckets of both are the same."""
        if name == "gone":
            return F.lit(0)
        if name == "postings":
            return bucket_of(F.col("term"), self.buckets)
        if name in ("extracted", "raw"):
            return F.pmod(F.conv(F.substring("sha256", 1, 4), 16, 10).cast("int"), F.lit(self.buckets))
        return F.pmod(F.xxhash64("path") if name == "documents" else F.col("document_id"), F.lit(self.buckets)).cast("int")

    def buckets_of(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of a table in which ``rows`` are looked up: no more than there are."""
        return sorted(r[0] for r in rows.select(self.bucket(name).alias("bucket")).where("bucket IS NOT NULL").distinct().collect())

    def _parts(self, name: str, state: dict, buckets: Iterable[int] | None = None) -> list[dict]:
        wanted = None if buckets is None else set(buckets)
        return [p for _, p in sorted(state["parts"].get(name, {}).items()) if wanted is None or p["bucket"] in wanted]

    def _rows(self, name: str, parts: list[dict]) -> DataFrame:
        if not parts:
            # known to be empty when a query is planned, so that joins with it move nothing
            return self.spark.range(0).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[self._place(p) for p in parts])

    def _place(self, part: dict) -> str:
        return f"{self.folder}/{part['path']}"

    def gone(self, state: dict) -> tuple[DataFrame, int]:
        """``document_id, gen`` of what is superseded, and how many that are."""
        parts = self._parts("gone", state)
        return self._rows("gone", parts).select("document_id", "gen"), sum(p["rows"] for p in parts)

    def _live(self, name: str, rows: DataFrame, state: dict) -> DataFrame:
        gone, n = self.gone(state)
        if not n or name not in (*OWNED, "extracted"):
            return rows
        if name == "extracted":
            used = self._live("documents", self._rows("documents", self._parts("documents", state)), state)
            return rows.join(used.select("sha256", "mime_type"), ["sha256", "mime_type"], "left_semi")
        return rows.join(bounded(gone, n), ["document_id", "gen"], "left_anti")

    def read(self, name: str, buckets: Iterable[int] | None = None, state: dict | None = None, stored: bool = False) -> DataFrame:
        """A table, or some buckets of one; empty if it was never written. ``stored`` adds the columns that only the store has."""
        state = state or self.state()
        rows = self._live(name, self._rows(name, self._parts(name, state, buckets)), state)
        return rows if stored else rows.select(*TABLES[name].names)

    def read_all(self) -> dict[str, DataFrame]:
        """All tables in one state."""
        state = self.state()
        return {name: self.read(name, state=state) for name in TABLES}

    def contents(self, name: str, keys: DataFrame, by: list[str], n: int, state: dict | None = None) -> DataFrame:
        """The rows of a table of contents that ``keys``, of ``n`` distinct rows, ask for, whether a document has them now or not.

        Only the buckets of the digests are read, and of those the row groups; the keys are broadcast while they are few.
        """
        rows = self._rows(name, self._parts(name, state or self.state(), self.buckets_of(name, keys)))
        return rows.join(bounded(keys.select(*by), n), by, "left_semi")

    def index(self, state: dict | None = None) -> StoredIndex:
        """The term index over all segments, as searches use it: nothing is rebuilt after an ingest."""
        state = state or self.state()
        parts = self._parts("postings", state)
        gone, n = self.gone(state)
        if not parts:
            rows = self.spark.createDataFrame([], T.StructType([*SCHEMAS["postings"], T.StructField("bucket", T.IntegerType())]))
        else:
            schema = T.StructType([*SCHEMAS["postings"], T.StructField("bucket", T.IntegerType())])
            rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/postings").parquet(*[self._place(p) for p in parts])
        numbers = self.numbers(state)
        rows = rows.join(bounded(gone, n), ["document_id", "gen"], "left_anti") if n else rows
        return StoredIndex(rows.select(*TABLES["postings"].names, "bucket"), self.buckets, numbers["indexed_chunks"], numbers["words"])

    def numbers(self, state: dict | None = None) -> dict[str, int]:
        """Documents, chunks, characters, embedded chunks, words and indexed chunks: sums over the log's lines, no table is read."""
        state = state or self.state()
        total = lambda name, key: sum(p[key] for p in self._parts(name, state))
        return {
            "documents": total("documents", "rows") - total("gone", "rows"),
            "chunks": total("chunks", "rows") - total("gone", "chunks"),
            "chars": total("chunks", "chars") - total("gone", "chars"),
            "embedded": total("chunks", "embedded") - total("gone", "embedded"),
            "words": total("postings", "words") - total("gone", "words"),
            "indexed_chunks": total("postings", "chunks") - total("gone", "chunks"),
        }

    def written(self, name: str, rows: DataFrame) -> dict[str, dict]:
        """Write ``rows`` as a new segment of a table that nobody sees yet; returns its parts for a commit."""
        return self.laid(name, self.dealt(name, rows))[0]

    def dealt(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` by their bucket, balanced by size: a bucket with much text is written by several tasks."""
        return rows.withColumn("bucket", self.bucket(name)).hint("rebalance", "bucket")

    def laid(self, name: str, rows: DataFrame, aside: Column | None = None) -> tuple[dict[str, dict], DataFrame]:
        """The same where the rows are: nothing moves, and each task writes a file a bucket. Returns the parts, and all that was written.

        What is ``aside``, and columns that a table has not, are for the caller alone: they are in no part, or not in its schema.
        """
        segment = f"s{uuid.uuid4().hex}"
        path = f"{name}/seg={segment}"
        more = [f for f in rows.schema if f.name not in (*SCHEMAS[name].names, "bucket")]
        bucket = self.bucket(name) if aside is None else F.when(aside, ASIDE).otherwise(self.bucket(name))
        frame = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]], *[f.name for f in more], bucket.alias("bucket"))
        frame.sortWithinPartitions("bucket", ORDER[name]).write.partitionBy("bucket").option("compression", COMPRESSION).parquet(f"{self.folder}/{path}")
        made = self.spark.read.schema(T.StructType([*SCHEMAS[name], *more, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.folder}/{path}")
        counts = made.where(F.col("bucket") != ASIDE).groupBy("bucket").agg(F.count("*").alias("rows"), *[F.expr(c).alias(n) for n, c in COUNTED.get(name, {}).items()]).collect()
        return {f"{r['bucket']}/{segment}": {"path": f"{path}/bucket={r['bucket']}"} | r.asDict() for r in counts}, made

    def commit(self, state: dict, add: dict[str, dict] | None = None, drop: dict[str, list[str]] | None = None, touched: dict[str, list[int]] | None = None, facts: dict[str, str] | None = None, run: tuple[str, int] | None = None) -> int:
        """Make parts that were written current, or raise :class:`ConflictError`; ``touched`` are the buckets that were read for it."""
        facts = {"buckets": str(self.buckets)} | (facts or {})
        return self._log.commit(state, {"add": add or {}, "drop": drop or {}, "touched": touched or {}, "facts": facts, "run": list(run) if run else None})

    def merge(self, fanout: int = FANOUT) -> int:
        """Join segments of a bucket where ``fanout`` of like size are; returns how many parts went. Another writer's work comes first."""
        state, went = self.state(), 0
        for name in SCHEMAS:
            tiers: dict[tuple[int, int], list[str]] = {}
            for key, part in sorted(state["parts"].get(name, {}).items()):
                tiers.setdefault((part["bucket"], int(math.log(part["rows"] + 1, fanout))), []).append(key)
            chosen = [k for keys in tiers.values() if len(keys) >= fanout for k in keys]
            if chosen:
                rows = self._rows(name, [state["parts"][name][k] for k in chosen])
                try:
                    self.commit(state, {name: self.written(name, rows)}, {name: chosen})
                except ConflictError:
                    continue
                went += len(chosen)
        return went

    def compact(self) -> None:
        """Make one segment a bucket of each table, without what is gone and without texts that no document has."""
        state = self.state()
        old = {name: list(state["parts"].get(name, {})) for name in SCHEMAS}
        add = {name: self.written(name, self._live(name, self._rows(name, self._parts(name, state)), state)) for name in TABLES if old[name]}
        # an ingest that relies on a text that goes here has to look again
        self.commit(state, add, old, {"extracted": list(range(self.buckets))} if old["extracted"] else {})

    def clean(self) -> int:
        """Remove the folders that are not current any more, and scratch; returns how many. Not while others write, or still read them."""
        current = {p["path"] for parts in self.state()["parts"].values() for p in parts.values()}
        files = Folder(self.spark, self.folder)
        lost = [f"scratch/{n}" for n in files.names("scratch")]
        for name in SCHEMAS:
            for segment in files.names(name):
                inner = [f"{name}/{segment}/{b}" for b in files.names(f"{name}/{segment}") if b.startswith("bucket=")]
                dead = [b for b in inner if b not in current]
                lost += dead if len(dead) < len(inner) else [f"{name}/{segment}"]
        for path in lost:
            files.delete(path)
        return len(lost)
