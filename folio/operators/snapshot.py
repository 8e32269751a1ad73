"""Verified snapshots of a knowledge base, and merging them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from folio.schemas import KEYS, TABLES

MANIFEST = "name string, part int, rows long, hash string, place string"
LOG = "number int, folder string"
#: Parts of a table, by a hash of its keys, that are copied and checked by themselves.
PARTS = 64


class SnapshotError(ValueError):
    """A snapshot that is there already, or is not whole."""


def _part(name: str) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(PARTS)).cast("int")


def fingerprints(name: str, rows: DataFrame) -> dict[int, tuple[int, str]]:
    """Rows and hash of each part of a table, whatever the order of its rows: the root of a tree of SHA-256 whose leaves are the
    rows, sorted by their own hash and gathered by its first digits."""
    leaf = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    rolled = lambda hashes: F.sha2(F.array_join(hashes, ","), 256)
    # leaves move as bytes, which are half as long and in the same order; they are digits again where they are gathered
    leaves = rows.select(_part(name).alias("part"), leaf.alias("leaf")).select("part", F.substring("leaf", 1, 3).alias("digits"), F.unhex("leaf").alias("leaf"))
    gathered = F.transform(F.sort_array(F.collect_list("leaf")), lambda x: F.lower(F.hex(x)))
    inner = leaves.groupBy("part", "digits").agg(F.count("*").alias("rows"), rolled(gathered).alias("hash"))
    roots = inner.groupBy("part").agg(F.sum("rows").alias("rows"), rolled(F.sort_array(F.collect_list(F.concat("digits", "hash")))).alias("hash"))
    return {r["part"]: (r["rows"], r["hash"]) for r in roots.collect()}


def _current(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest whole snapshot at ``path``: that of the newest line of its log, which is written last."""
    try:
        lines = spark.read.schema(LOG).parquet(f"{path}/log").orderBy(F.desc("number")).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return f"{path}/{lines[0]['folder']}" if lines else None


def _lines(spark: SparkSession, folder: str) -> list[Row]:
    """A line a part."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()


def export_snapshot(tables: dict[str, DataFrame], path: str, force: bool = False) -> DataFrame:
    """Write all tables into a new folder below ``path``, read them back, and only if they agree make it the current one.

    Returns its manifest. With ``force`` a snapshot that is there is superseded, and stays whole until the new one is. Parts that
    are as they were then are not copied again: the new manifest names them where they are.
    """
    spark = next(iter(tables.values())).sparkSession
    before = _current(spark, path)
    if before and not force:
        raise SnapshotError(f"there is a snapshot at {path}")
    number = int(before.rsplit("v", 1)[1]) + 1 if before else 1
    known = {(r["name"], r["part"], r["rows"], r["hash"]): r["place"] for r in (_lines(spark, before) if before else [])}
    folder, lines = f"{path}/v{number}", []
    for name, rows in tables.items():
        schema = TABLES[name]
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        wanted = fingerprints(name, rows)
        place = {part: known.get((name, part, *of)) for part, of in wanted.items()}
        new = sorted(part for part, there in place.items() if there is None)
        if new:
            written = f"v{number}/{name}"
            rows.withColumn("part", _part(name)).where(F.col("part").isin(new)).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/{written}")
            found = fingerprints(name, spark.read.schema(schema).parquet(f"{path}/{written}").select(*schema.names))
            if found != {part: wanted[part] for part in new}:
                raise SnapshotError(f"{name} differs from what was written")
            place |= {part: f"{written}/part={part}" for part in new}
        lines += [(name, part, *wanted[part], place[part]) for part in sorted(wanted)] or [(name, -1, 0, "", "")]
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    spark.createDataFrame([(number, f"v{number}")], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def open_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a whole snapshot; anything that is missing or differs is an error before anything is changed."""
    folder = _current(spark, path)
    if folder is None:
        raise SnapshotError(f"there is no whole snapshot at {path}")
    lines, out = _lines(spark, folder), {}
    for name in dict.fromkeys(r["name"] for r in lines):
        parts = [r for r in lines if r["name"] == name and r["part"] >= 0]
        if not parts:
            out[name] = spark.createDataFrame([], TABLES[name])
            continue
        try:
            rows = spark.read.schema(TABLES[name]).parquet(*[f"{path}/{r['place']}" for r in parts])
            found = fingerprints(name, rows)
        except AnalysisException as e:
            raise SnapshotError(f"{name} is not whole: {e}") from e
        if found != {r["part"]: (r["rows"], r["hash"]) for r in parts}:
            raise SnapshotError(f"{name} differs from its manifest")
        out[name] = rows
    return out


def merged(snapshot: DataFrame, target: DataFrame, keys: list[str], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The target with the snapshot's rows, and ``status, n``: by default rows that exist stay, with ``force`` they give way."""
    if force:
        rows = snapshot.unionByName(target.join(snapshot.select(*keys), keys, "left_anti").select(*snapshot.columns))
        return rows, snapshot.agg(F.count("*").alias("n")).select(F.lit("written").alias("status"), "n")
    rows = target.unionByName(snapshot.join(target.select(*keys), keys, "left_anti").select(*target.columns))
    there = target.select(*keys).withColumn("there", F.lit(1))
    status = F.when(F.col("there").isNull(), "written").otherwise("skipped")
    return rows, snapshot.select(*keys).join(there, keys, "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def restore_snapshot(path: str, tables: dict[str, DataFrame], force: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """New states of the tables, and ``name, status, n`` of what was written and skipped."""
    spark = next(iter(tables.values())).sparkSession
    found = open_snapshot(spark, path)
    out, report = dict(tables), None
    for name, rows in found.items():
        target = tables.get(name)
        if target is None:
            target = spark.createDataFrame([], TABLES[name])
        out[name], counts = merged(rows, target, KEYS[name], force)
        line = counts.select(F.lit(name).alias("name"), "status", "n")
        report = line if report is None else report.unionByName(line)
    return out, report
