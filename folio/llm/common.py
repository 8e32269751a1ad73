"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators.ingest import small_batches
from folio.sources.scratch import until_exit

#: Rows of one key that a join leaves in one task, and the most keys with more that are broadcast.
HOT_ROWS, MOST_HOT = 1_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark alone opens the path, so it may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent and Spark runs in one local JVM, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="folio-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: its lineage is cut, and a lost executor loses nothing of it.

    The table goes by :func:`removed`, or when the driver ends. Python workers get few rows at once: whole texts are large rows, and
    each batch is there in the worker, in the JVM's buffers and as what is made of it.
    """
    spark = df.sparkSession
    path = until_exit(spark, f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}")
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_at"] = path
    return out


def removed(*frames: DataFrame) -> None:
    """Delete tables that :func:`written` gave and nothing will read again; other frames are left alone."""
    for frame in frames:
        if path := frame.__dict__.get("_written_at"):
            context = frame.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def unskewed(rows: DataFrame, few: DataFrame, keys: list[str], spread: list[str], n: str = "n", counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``few``, which has one row for each of ``keys``; ``n``, in ``few`` or in ``counts``, says how
    many ``rows`` have it.

    A key of more than ``HOT_ROWS`` rows is dealt over as many tasks as it has times that many rows, by a hash of ``spread``,
    and its row of ``few`` is repeated for each. Only the list of such keys is broadcast: the bound rises with the table, so that
    there are at most ``MOST_HOT`` of them whatever the data.
    """
    counts = few if counts is None else counts
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    bound = max(HOT_ROWS, -(-total // MOST_HOT))
    hot = F.broadcast(counts.where(F.col(n) > bound).select(*keys, F.ceil(F.col(n) / bound).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    repeated = few.drop(n).join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")


def hash_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """All rows of ``df`` if it has at most ``most``, else about as many: those whose hash of ``columns`` is smallest.

    The rows are chosen one by one against a fixed bound, so nothing is sorted or gathered, and a rerun chooses the same.
    """
    n = df.count()
    bound = int(most / max(n, 1) * (1 << 31))
    return df if n <= most else df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) < bound)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays (``lower`` would also change letters such as É)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hidden(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give back to the system what a Python worker has freed: it stays for later stages, and their memory comes beside its own."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def very_frequent(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The ``keys`` that more than ``HOT_ROWS`` of ``rows`` have, to be broadcast; None if there are none.

    As in :func:`unskewed` the bound rises with the table, so that there are at most ``MOST_HOT``.
    """
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS), "frequent")
    n, total = counts.agg(F.count("*"), F.sum("n")).first()
    return F.broadcast(counts.where(F.col("n") > max(HOT_ROWS, total // MOST_HOT)).drop("n")) if n else None


def few_or_shuffled(few: DataFrame, n: int) -> DataFrame:
    """``few``, of ``n`` counted rows, with a broadcast hint if these are at most ``MOST_HOT``; else the join shuffles."""
    return F.broadcast(few) if n <= MOST_HOT else few


def numbered(rows: DataFrame, name: str, *by: Column) -> DataFrame:
    """``rows`` with ``name``: their numbers from 0 in the order ``by``. Rows should differ in it, or their order is any.

    Rows are dealt by ranges and written with the number of their range, which is fixed from then on; a row a range is summed up.
    """
    part = hidden(rows, "range")
    dealt = written(rows.repartitionByRange(*by).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(part, start.alias(name))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*by)) - 1
    return dealt.withColumn(name, place).alias("r").join(F.broadcast(sizes).alias("s"), part).select(*[f"r.`{c}`" for c in rows.columns], (F.col(f"r.{name}") + F.col(f"s.{name}")).alias(name))
