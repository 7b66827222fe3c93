"""Line dedup: which lines of each document to keep, as compressed bitmaps.

Each document's distinct line keys become hashes; (hash, document, positions) rows are range-partitioned by hash and
document and sorted by hash, then document from the largest down, then row. Repeats of a row fall together on the way. One pass streams over a partition:
the first document of a run of equal hashes keeps its lines, and once a fifth distinct document has come, all others'
lines go. The range bounds hold the document too, so a hash in a third of all documents is spread over many
partitions; runs that touch a partition's edge are settled from one count a partition and run, joined back. So is a run in which
very many rows come before its fifth document, as rows without an id do, which are one document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm._common import as_bytes, by_column, lists, written

#: Fixed value: what is stripped from a line's ends.
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _code_points(utf8: bytes) -> int:
    return len(utf8) if utf8.isascii() else len(utf8.decode())


def _occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """h1, h2 (128 bits of a key), doc_id, row_key, at (positions of its lines): one row for each document and key.

    Repeats of a row in one batch are one; others are left to the pass over sorted rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row_keys, texts in by_column(batches, "doc_id", "row_key", "text"):
            keys, owner, counts, at = [], [], [], []
            seen = set()
            for i, (row, text) in enumerate(zip(zip(ids.to_pylist(), row_keys.to_pylist()), as_bytes(texts))):
                if row in seen:
                    continue
                seen.add(row)
                found: dict[bytes, list[int]] = {}
                for n, line in enumerate(text.split(b"\n")):
                    if len(line) >= least_chars:
                        key = line_key(line)
                        if len(key) >= least_chars and _code_points(key) >= least_chars:
                            found.setdefault(xxhash.xxh3_128_digest(key), []).append(n)
                for key, where in found.items():
                    keys.append(key)
                    owner.append(i)
                    counts.append(len(where))
                    at.extend(where)
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), ids.take(take), row_keys.take(take), lists(counts, pa.array(at, pa.int32()))],
                ["h1", "h2", "doc_id", "row_key", "at"],
            )

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, row_key long, at array<int>")


JUDGED = "kind int, h1 long, h2 long, doc_id long, row_key long, at array<int>, n_docs long"
DROP, OPEN, COUNT = 0, 1, 2
#: Rows of a run that may wait for its fifth document.
MOST_WAITING = 10_000


def _judge(sorted_rows: DataFrame, least_docs: int) -> DataFrame:
    """One pass over sorted partitions. DROP: lines to drop. Of a partition's first and last hash, COUNT: its documents
    here and the largest; OPEN: rows that depend on other partitions. A run with too many rows to wait is told in the same way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = top = last = before = None
        at_edge, settled, n_docs, waiting = True, False, 0, []

        def end(last_run: bool) -> None:
            if key is not None and (at_edge or last_run):
                out.append((COUNT, *key, top, None, None, n_docs))
                if not settled:
                    out.extend((OPEN, *key, d, r, at, None) for d, r, at in waiting)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
            names = ["kind", "h1", "h2", "doc_id", "row_key", "at", "n_docs"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for columns in by_column(batches, "h1", "h2", "doc_id", "row_key", "at"):
            for h1, h2, doc, row, at in zip(*(c.to_pylist() for c in columns)):
                if (h1, h2, doc, row) == before:  # a repeat of a row
                    continue
                before = (h1, h2, doc, row)
                if (h1, h2) != key:
                    end(False)
                    at_edge, settled, n_docs, waiting = key is None, False, 1, []
                    key, top, last = (h1, h2), doc, doc
                elif doc != last:
                    n_docs, last = n_docs + 1, doc
                if at_edge:
                    out.append((OPEN, h1, h2, doc, row, at, None))
                elif settled:
                    if doc != top:
                        out.append((DROP, h1, h2, doc, row, at, None))
                else:
                    waiting.append((doc, row, at))
                    if n_docs >= least_docs:
                        settled = True
                        out.extend((DROP, h1, h2, d, r, p, None) for d, r, p in waiting if d != top)
                        waiting = []
                    elif len(waiting) > MOST_WAITING:
                        at_edge = True
                        out.extend((OPEN, h1, h2, d, r, p, None) for d, r, p in waiting)
                        waiting = []
            if len(out) >= MOST_WAITING:
                yield batch()
                out.clear()
        end(True)
        if out:
            yield batch()

    return sorted_rows.mapInArrow(run, JUDGED)


def pack(dropped: list[int]) -> bytes:
    """A keep bitmap up to the byte of the last dropped line, compressed; lines beyond it are kept."""
    keep = np.ones(-(-(max(dropped) + 1) // 8) * 8, bool)  # whole bytes, so that what pads the last one is kept too
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n].astype(bool)
        keep[: len(bits)] = bits
    return keep


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_key"), F.col(text_col).cast("string").alias("text"))


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (a hash of the text), keep (compressed bitmap): for each document that loses lines.

    A document without a row keeps every line. Null text is one empty line, too short to be dropped. Documents
    without an id count as one, smaller than all others; repeated rows lose the same lines.
    """
    rows = _occurrences(_named(docs, id_col, text_col), least_chars)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_down = F.col("doc_id").desc_nulls_last()
    ordered = rows.repartitionByRange(n, "h1", "h2", doc_down).sortWithinPartitions("h1", "h2", doc_down, "row_key")
    judged = written(_judge(ordered, least_docs))
    totals = judged.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= least_docs)
    totals = written(totals)
    # Two rows a partition, and one for each run of very many rows of few documents, where there are such.
    few = totals.count() <= 2 * n
    late = judged.where(F.col("kind") == OPEN).join(F.broadcast(totals) if few else totals, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    drops = judged.where(F.col("kind") == DROP).select("doc_id", "row_key", "at").unionByName(late.select("doc_id", "row_key", "at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, at in by_column(batches, "doc_id", "row_key", "at"):
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array([pack(x) for x in at.to_pylist()], pa.binary())], ["doc_id", "row_key", "keep"])

    each = drops.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("at")).alias("at"))  # no more than a text's lines
    return each.mapInArrow(run, "doc_id long, row_key long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of the columns of docs), kept_text, n_lines, n_dropped: one row for each of docs."""
    return _with_kept(docs, bitmaps, id_col, text_col, digest=False)


def _with_kept(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    added = ["kept_sha256" if digest else "kept_text", "n_lines", "n_dropped"]
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if not digest else docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("row"), F.col(text_col).alias("_text"))
    text = F.col("_text") if digest else F.col(f"row.`{text_col}`")
    doc = F.col("row.doc_id") if digest else F.col(f"row.`{id_col}`")
    left = rest.select("row", text.cast("string").alias("_t"), doc.cast("long").alias("_d")).withColumn("_r", F.xxhash64("_t"))
    joined = left.join(bitmaps, left["_d"].eqNullSafe(bitmaps["doc_id"]) & (left["_r"] == bitmaps["row_key"]), "left").select("row", "_t", "keep")
    kind = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts, keeps in by_column(batches, "row", "_t", "keep"):
            kept, n_lines, n_dropped = [], [], []
            for text, keep in zip(as_bytes(texts), keeps.to_pylist()):
                parts = text.split(b"\n")
                if keep is not None:
                    bits = unpack(keep, len(parts))
                    text = b"\n".join(p for p, k in zip(parts, bits) if k)
                    n_dropped.append(int((~bits).sum()))
                else:
                    n_dropped.append(0)
                n_lines.append(len(parts))
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([row, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", *added])

    return joined.mapInArrow(run, f"row {kind}, {added[0]} string, n_lines long, n_dropped long")


def dedup_digest(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each of docs.

    A null or empty text is one empty line. Rows without an id are one document, smaller than all others; repeated rows lose the same
    lines. A very long text is read whole. An empty table gives no rows. Other columns of docs are left out, whatever their names.
    """
    out = _with_kept(docs, keep_bitmaps(docs, least_chars, least_docs, id_col, text_col), id_col, text_col, digest=True)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")
