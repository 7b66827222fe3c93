"""Importance resampling towards a target corpus (Xie et al., 2023): hashed n-grams, log ratios, a Gumbel top-k draw.

Features are runs of up to n words. Their buckets are CRC-32 values modulo the number of buckets, and a CRC can be carried on: the
state after "a b" is the state after "a", extended by a space and "b". So one scan over a document's words keeps a ring of zlib states,
one for each of the last n starts; each word extends them all, opens one more, and the oldest falls out. No feature is ever put together as text.

Two scans of the documents: one counts buckets (a row of counts a task, summed), one weighs. Between them only the counts are kept, whose
number is a parameter. The draw needs the order of all scores: rows are range-partitioned by it and numbered inside their partition, and the
number of rows in the partitions before is added.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm._common import as_bytes, by_column, lower_words, written

#: Longest feature in words, buckets, least words of a document that can be drawn, share drawn (percent) and seed: fixed values of the query.
ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024


def ring(words: Iterable[bytes], n: int) -> Iterator[int]:
    """CRC-32 of every run of 1 to n consecutive words, joined by one space, in order of their last words."""
    if n == 1:
        yield from map(crc32, words)
        return
    states: list[int] = []  # of the last n - 1 starts, the oldest first
    for word in words:
        more = b" " + word
        states = [crc32(more, s) for s in states]
        states.append(crc32(word))
        yield from states
        if len(states) == n:
            del states[0]


def buckets_of(text: bytes, n: int, buckets: int) -> tuple[np.ndarray, int]:
    """The buckets of a text's features, and its number of words."""
    words = lower_words(text)
    n_features = sum(max(0, len(words) - m) for m in range(n))
    return np.fromiter(ring(words, n), np.uint32, n_features) % np.uint32(buckets), len(words)


def bucket_counts(docs: DataFrame, n: int = ORDER, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """bucket, n: how many features of all docs are in each bucket that has some. A task gives one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for (texts,) in by_column(batches, "text"):
            for text in as_bytes(texts):
                total += np.bincount(buckets_of(text, n, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: list[int], target: list[int]) -> list[int]:
    """A thousand times the log of how much likelier each bucket is in the target, both counted with one more feature a bucket; rounded down."""
    of, to, size = float(sum(counts)), float(sum(target)), len(counts)
    return [math.floor(1000 * math.log((t + 1.0) * (of + size) / ((s + 1.0) * (to + size)))) for s, t in zip(counts, target)]


def _gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 G), G being Gumbel noise from the first 32 bits of the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: list[int], n: int = ORDER, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain; 0 without features), score (weight and noise): one row for each of docs."""
    buckets, held = len(gain), np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in by_column(batches, "doc_id", "text"):
            out = []
            for text in as_bytes(texts):
                at, words = buckets_of(text, n, buckets)
                out.append((words, len(at), int(held[at].sum()) // len(at) if len(at) else 0))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in zip(*out))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), seed))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """weighed with rank: 1, 2, 3... for the highest scores of the rows of ``least_words`` or more, that share of them; null for others.

    Ties go to the smaller doc_id, null last. A range of the order is sorted at a time; only one row a range meets in one place.
    """
    able = F.col("n_words") >= least_words
    order = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    n = int(weighed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id holds the range in its upper bits and the place in it in the lower 33.
    placed = written(weighed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(able).alias("able")).orderBy("part").collect()  # one row a range
    drawn = sum(r["able"] for r in sizes) * percent // 100
    before = [0, *accumulate(r["n"] for r in sizes)]
    starts = placed.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "_part long, _before long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", (F.col("_before") + place + 1).cast("long"))
    return numbered.withColumn("rank", F.when(able & (F.col("rank") <= drawn), F.col("rank"))).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame, target: DataFrame, n: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row for each of docs; rank is null for those that are not drawn.

    Null and empty texts have no features, weight 0, and are not drawn, as are all texts under ``least_words`` words. A null id draws its noise as the
    word null, and comes last among ties. Repeated rows are documents of their own with equal scores; each has its own rank. Very long texts are
    scanned whole, a document at a time. An empty target gives weights by how common features are in docs; an empty table of docs gives
    no rows. Other columns are left out, whatever their names.
    """
    counts = [0] * buckets, [0] * buckets
    for held, table in zip(counts, (bucket_counts(docs, n, buckets, text_col), bucket_counts(target, n, buckets, target_col))):
        for r in table.collect():  # a row a bucket, whatever the number of documents
            held[r["bucket"]] = r["n"]
    # Written, since ranges are chosen by a look at the rows before they are dealt.
    return draw(written(weigh(docs, gains(*counts), n, seed, id_col, text_col)), percent, least_words)
