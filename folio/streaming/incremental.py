"""Incremental ingest of a growing folder as a stream of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions import text as X
from folio.operators.ingest import Options, ingest
from folio.schemas import FILES
from folio.sources.files import EXTENSIONS
from folio.sources.store import Store


def ingest_stream(store: Store, folder: str, checkpoint: str, options: Options = Options(), files_a_batch: int = 10_000) -> StreamingQuery:
    """Ingest what is new in ``folder`` and stop. A batch is committed once: its number goes with the state, and a replay does nothing.

    The stream is known by its checkpoint; with a new one its batches are new, and files with a known hash are skipped.
    """
    reader = store.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch)
    files = reader.load(folder).where(F.lower(X.extension(F.col("path"))).isin(EXTENSIONS)).withColumn("path", X.local_path(F.col("path")))

    name = f"stream {checkpoint}"

    def batch(rows: DataFrame, number: int) -> None:
        last_run = store.last_run(name)
        if last_run is not None and number <= last_run:
            return
        # of a file seen twice in a batch the last state counts
        last = rows.groupBy("path").agg(F.max_by(F.struct("modificationTime", "length", "content"), "modificationTime").alias("f")).select("path", "f.*")
        ingest(store, last, options, (name, number))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
