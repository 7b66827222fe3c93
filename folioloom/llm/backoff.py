"""Stupid-backoff scores of documents (Brants et al., 2007), each against all other documents.

S(w | context) = f(context w) / f(context) if the n-gram occurs, else ALPHA * S(w | shorter context); the shortest context is
the empty n-gram, whose count is the number of words. A document's own n-grams do not count for it: f is the corpus count less the document's.

Documents are dealt into blocks by hash. A block's distinct n-grams, with their counts in it, are exploded once, partitioned by their hash, and
each gets its corpus count by a sum over all blocks that have it: the count table and its join to the exploded n-grams are one window, so an n-gram
is shuffled once. What a block knows already (counts that no other block adds to) is left out; the others return to their block,
where log scores are summed for each document.

An n-gram in every document is one row a block, so no partition has more of it than there are blocks. N-grams travel as one array for each block
and part of the hashes, which saves bytes and nothing else: they are rows before they are counted, and an array may be as short as one.
Different n-grams of one 64-bit hash count as one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm._common import BASE, as_bytes, bits_of, hashes, lists, mixed, trim, written

#: Longest n-gram, weight of a shorter context, ranges of hashes that are counted one after the other, bytes of text in a block and for each partition of the counts.
ORDER, ALPHA, PASSES, BLOCK_BYTES, PART_BYTES = 2, 0.4, 2, 8 << 20, 16 << 20

#: Parts of the hashes for each partition, so that partitions are even; bytes of text below which neither blocks nor partitions are made smaller
#: to keep all tasks busy; an n-gram's place in its block is in the low bits of `first` and `at`.
PARTS, LEAST_BYTES, PLACE_BITS = 4, 1 << 20, 32


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a block's words: each one's document, its place in it, and the hash of the m-gram that ends with it (m = 1 ..)."""
    each = [hashes(t.split()) for t in texts]  # words themselves are held for one document at a time
    lengths = np.array([len(w) for w in each], np.int64)
    doc = np.repeat(np.arange(len(each)), lengths)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    words = np.concatenate([np.zeros(0, np.uint64), *each])
    out, run = [], np.zeros(len(words), np.uint64)
    for m in range(1, order + 1):
        # The polynomial of the last m words: what is before a document's start is never used.
        run[m - 1 :] += words[: max(len(words) - m + 1, 0)] * np.uint64(pow(BASE, m - 1, 1 << 64))
        out.append(mixed(run + np.uint64(m)))
    return doc, place, out


def _counted(grams: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams and their counts, each occurrence as often as its document has copies."""
    if (copies == 1).all():
        return np.unique(grams, return_counts=True)
    distinct, at = np.unique(grams, return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, at, copies)
    return distinct, counts


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score, mean_log_score: one row for each of docs, over its whole text.

    n_backoff is how many words had to do with a shorter context. A word that no other document has counts as 1 / (N + 1),
    N being the other documents' words. Without words log_score is 0 and mean_log_score null. Null text has no words. Repeated rows
    are other documents to each other, and each has its row; they are scored once. A very long text is exploded whole, an empty table gives no rows.
    Other columns of docs are left out.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    # A row goes from each block to each part, so there are no more of either than the texts need, whatever the number of shuffle partitions.
    blocks, partitions = (max(1, min(n, -(-size // min(b, LEAST_BYTES))), -(-size // b)) for b in (block_bytes, PART_BYTES))
    bits = (PARTS * partitions - 1).bit_length()
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    d = d.repartition(blocks, "block").groupBy("block", "doc_id", "text").agg(F.count("*").alias("copies"))

    def exploded(part: int):
        """A function of a block: its distinct n-grams and their counts, in order, cut where the first bits of the hash change."""

        def explode(group: pa.Table) -> pa.Table:
            doc, place, grams = _grams(as_bytes(group["text"].combine_chunks()), order)
            copies = group["copies"].to_numpy()[doc]
            first = group["block"][0].as_py() << PLACE_BITS
            rows = []
            for m in range(order + 1):
                if m == 0:  # the empty n-gram, once for each word
                    key, count = np.zeros(1, np.uint64), np.array([copies.sum()])
                else:
                    key, count = _counted(grams[m - 1][place >= m - 1], copies[place >= m - 1])
                of = (key >> np.uint64(64 - bits)).astype(np.int64)
                here = of % passes == part
                parts, start, length = np.unique(of[here], return_index=True, return_counts=True)
                at = first + np.flatnonzero(here)[start]
                rows.append((parts, at, length, bits_of(key[here]), count[here].astype(np.int64)))
                first += len(key)
            parts, at, length, key, count = (np.concatenate(c) for c in zip(*rows))
            out = pa.table({"part": pa.array(parts), "first": pa.array(at), "grams": lists(length, pa.array(key)), "counts": lists(length, pa.array(count))})
            trim()
            return out

        return explode

    def told(part: int) -> DataFrame:
        """block, place, f: the corpus count of each n-gram of a block that others have too."""
        runs = d.groupBy("block").applyInArrow(exploded(part), "part long, first long, grams array<long>, counts array<long>")
        each = runs.repartition(partitions, "part").select("part", "first", "counts", F.posexplode("grams").alias("i", "gram"))
        each = each.select("part", "gram", (F.col("first") + F.col("i")).alias("at"), F.col("counts")[F.col("i")].alias("n"))
        f = each.withColumn("f", F.sum("n").over(Window.partitionBy("gram", "part"))).where("f > n")
        return written(f.select(F.shiftright("at", PLACE_BITS).alias("block"), F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("place"), "f"))

    def judge(group: pa.Table, known: pa.Table) -> pa.Table:
        doc, place, grams = _grams(as_bytes(group["text"].combine_chunks()), order)
        of, copies = len(group), group["copies"].to_numpy()
        n_words = np.bincount(doc, minlength=of)
        where, f = known["place"].to_numpy(), known["f"].to_numpy()
        by_place = np.argsort(where)
        where, f = where[by_place], f[by_place]

        def corpus(counts: np.ndarray, first: int) -> np.ndarray:
            """Counts in all blocks, of n-grams whose counts in this one are given."""
            a, b = np.searchsorted(where, (first, first + len(counts)))
            counts = counts.astype(np.float64)
            counts[where[a:b] - first] = f[a:b]
            return counts

        others = corpus(np.array([(n_words * copies).sum()]), 0)[0] - n_words[doc]
        first, score, short, context = 1, 1 / (others + 1), np.zeros(len(doc), bool), others
        for m, g in enumerate(grams):
            able = np.flatnonzero(place >= m)
            key, at = np.unique(g[able], return_inverse=True)
            counts = np.bincount(at, copies[doc[able]], len(key))
            _, own, mine = np.unique(doc[able] * len(key) + at, return_inverse=True, return_counts=True)
            left = np.zeros(len(doc))  # what other documents have of the m-gram that ends at each word
            left[able] = corpus(counts, first)[at] - mine[own]
            first += len(key)
            seen = left > 0
            backed = score if m == 0 else np.where(place >= m, alpha * score, score)
            score = np.where(seen, left / np.maximum(context, 1), backed)
            if m:
                short = np.where(seen, False, short | (place >= m))
            context = np.concatenate([[0.0], left[:-1]])
        log = np.bincount(doc, np.log(score), of).astype(np.float64)
        n_backoff = np.bincount(doc, short, of).astype(np.int64)
        trim()
        return pa.table({"doc_id": group["doc_id"], "copies": group["copies"], "n_words": pa.array(n_words.astype(np.int64)), "n_backoff": pa.array(n_backoff), "log_score": pa.array(log)})

    known = reduce(DataFrame.union, [told(p) for p in range(passes)])
    out = d.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(judge, "doc_id long, copies long, n_words long, n_backoff long, log_score double")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_backoff", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
