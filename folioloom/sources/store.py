"""Tables between steps: JSON and JSON Lines, clusters, snapshots, written intermediates."""

from __future__ import annotations

import atexit
import json
import os
import re
import tempfile
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_scratch: list[tuple[SparkSession, str]] = []


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete_all() -> None:
    for spark, path in _scratch:
        try:
            fs, at = _path(spark, path)
            fs.delete(at, True)
        except Exception:  # the session has ended
            pass


atexit.register(_delete_all)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark is local, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="folioloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows are dealt that take long for their size: given as a number, Spark does not merge them by their bytes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Spark's setting by which an execution's shuffle files are removed at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: lineage is cut. Its shuffle files go at once, the table with ``forget`` or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioloom-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Written tables that nothing will read again are deleted before the driver ends."""
    for t in tables:
        if path := getattr(t, "_written", None):
            fs, at = _path(t.sparkSession, path)
            fs.delete(at, True)
            _scratch[:] = [s for s in _scratch if s[1] != path]


def numbered(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """df with the place of each row in the order of some columns, from 1, without a task that sorts all.

    Rows are range-partitioned and numbered within their range; the rows of the ranges before are added. One row a range meets in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    before = [0, *accumulate(r["n"] for r in sizes)]
    starts = df.sparkSession.createDataFrame([(r["p"], b) for r, b in zip(sizes, before)], "_part long, _before long")
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, default: DataFrame | None = None) -> DataFrame:
    """A JSON document or array; ``default`` where the path cannot be read."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception:
        if default is None:
            raise
        return default


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines; blank and malformed lines are skipped, also where columns are pruned."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("r")).where(F.col("r._bad").isNull()).select(*[F.col(f"r.{f.name}") for f in kind.fields])


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appended as new part files: an unfinished line of an earlier run cannot run into them."""
    df.write.mode("append").json(path)


def write_clusters(rows: DataFrame, path: str) -> None:
    """Rows partitioned by cluster_id; those that stand alone (size 1) in a partition of their own. What was there goes."""
    kind = F.when(F.col("size") > 1, F.col("cluster_id").cast("string")).otherwise("isolated")
    rows.withColumn("cluster", kind).write.mode("overwrite").partitionBy("cluster").parquet(path)


def read_clusters(spark: SparkSession, path: str, lexical: bool = False) -> DataFrame:
    """Clustered rows by cluster_id, or by its digits as text, as file names would be ordered."""
    rows = spark.read.option("recursiveFileLookup", False).parquet(path).where(F.col("cluster").cast("string") != "isolated").drop("cluster")
    return rows.orderBy(F.col("cluster_id").cast("string") if lexical else F.col("cluster_id"), "seq")


def read_isolated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("cluster").cast("string") == "isolated").drop("cluster")


def folder_name(run: str) -> str:
    flat = "".join(c for c in run.replace("/", "__").replace("\\", "__") if c.isprintable())
    return flat or "unknown_run"


def literal(path: str) -> str:
    """A path for readers, which take brackets and stars for patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def snapshot(tables: dict[str, DataFrame], root: str, run: str, saved_at: float, options: dict) -> str:
    """All result tables of a run in a folder named after it, beside its options; an older one of that name is replaced."""
    at = f"{root.rstrip('/')}/{folder_name(run)}"
    spark = next(iter(tables.values())).sparkSession
    fs, path = _path(spark, at)
    fs.delete(path, True)
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}")
    meta = spark.createDataFrame([(run, saved_at, json.dumps(options, ensure_ascii=False))], "run string, saved_at double, options string")
    meta.coalesce(1).write.json(f"{at}/run_meta")
    return at


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small document at any path that Spark can write to, whole or not at all: written beside, then renamed over what was there."""
    fs, at = _path(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
    if not fs.rename(part, at):  # most file systems do not rename over a file
        fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"cannot write {path}")

