"""Where queries that write tables put them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession


_LEFT: list[tuple[object, object, str]] = []


@atexit.register
def _sweep() -> None:
    """Remove, when the driver ends, what lazy results have read until then."""
    for jvm, conf, path in _LEFT:
        with suppress(Exception):  # the JVM may have gone before; the folder is then left to whoever clears the shared one
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is removed when the driver ends."""
    _LEFT.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, below ``spark.checkpoint.dir``, until the driver ends.

    Only a session in one local JVM without that setting gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="folio-")
    return until_exit(spark, f"{shared}/{name}-{uuid.uuid4().hex}")
