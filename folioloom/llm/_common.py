"""What several operators share: words, hashes, Arrow columns, written intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: a word, as a Java and Python pattern. bytes.split() cuts at exactly the other characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting by which an execution's shuffle files are removed at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and Spark is local, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="folioloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: nothing left to delete with
        pass


@atexit.register
def _delete_all() -> None:
    for spark, path in _scratch:
        _delete(spark, path)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and lost executors cost no work done before.

    Its shuffle files go as soon as it is written. The table itself is deleted when the driver ends.
    """
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
            _delete(t.sparkSession, path)
            _scratch[:] = [s for s in _scratch if s[1] != path]


def trim() -> None:
    """What a worker has freed goes back to the system, so that one group's peak does not stay for the next."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Bytes as they are read by lower_words: A-Z in lower case, letters, digits and all of other scripts as they are, the rest blank.
_LOWER = bytes(c if c >= 0x80 or 0x30 <= c < 0x3A or 0x61 <= c < 0x7B else c + 32 if 0x41 <= c < 0x5B else 32 for c in range(256))


def lower_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, only A-Z in lower case."""
    return text.translate(_LOWER).split()


def by_column(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[pa.Array]]:
    for b in batches:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(n)) for n in names]


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier: window hashes are polynomials in it, modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words, from the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):  # k passes over contiguous memory; no window is copied
        out *= np.uint64(BASE)
        out += words[j : j + n]
    return mixed(out)


def bits_of(x: np.ndarray) -> np.ndarray:
    """int64 with the same bits, as Spark's long."""
    return x.view(np.int64)


def lists(lengths: np.ndarray | list[int], values: pa.Array) -> pa.Array:
    """A list column whose rows take so many values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
