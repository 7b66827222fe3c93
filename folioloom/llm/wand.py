"""Ranked lexical search by WAND (Broder et al., 2003) over shards of documents.

A shard is an inverted index of some thousand documents that one task reads one after the other, restricted to the terms that the queries
have: one row, so that no document is ever shuffled. Document frequencies, the number of documents and of terms are summed over the shards. A
term's impact on a document follows from these, so its largest impact in a shard is known before any query is scored.

For each query a task keeps a heap of its best documents over all shards that it reads. In a shard, the query's posting lists are sorted by the
document that their cursors are at. The pivot is the first list at which the sum of the largest impacts, from the first list on, reaches the
heap's threshold: no document before the pivot's can enter the heap, so all cursors skip to it. From there a window of documents is looked at: of
those whose terms' largest impacts reach the threshold the score is summed, the others are skipped too. The heaps of all tasks are merged by rank.
Documents at the threshold itself are scored, since ties go by id.

Queries are searched in blocks, which bounds what a task holds; each block has an index of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm._common import as_bytes, by_column, forget, lists, lower_words, written

#: Documents of a result: fixed value of the query.
TOP = 20
#: A shard ends at so many documents or postings; documents of a window; terms of a block of queries (or one query).
SHARD_DOCS, SHARD_POSTINGS, WINDOW, BLOCK_TERMS = 8192, 1_000_000, 1024, 1_000_000

SHARD = "docs array<long>, n array<long>, term array<int>, df array<int>, at array<int>, tf array<int>, n_docs long, n_terms long"


def _index(docs: DataFrame, vocabulary: dict[bytes, int], shard_docs: int, shard_postings: int) -> DataFrame:
    """Shards: ids and lengths of their documents, and for each term (a number) its postings: places among the documents, and frequencies.

    Only documents with a term of the vocabulary are listed. n_docs and n_terms count all.
    """
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = words.value.get
        ids: list[int | None] = []
        lengths: list[int] = []
        terms: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        n_docs = n_terms = held = 0

        def shard() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
            term, tf = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (terms, counts))
            order = np.argsort(term, kind="stable")  # a term's documents stay in order
            names, df = np.unique(term, return_counts=True)
            columns = [lists([len(ids)], pa.array(ids, pa.int64())), lists([len(ids)], pa.array(lengths, pa.int64()))]
            columns += [lists([len(x)], pa.array(x.astype(np.int32))) for x in (names, df, owner[order], tf[order])]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n_docs]), pa.array([n_terms])], ["docs", "n", "term", "df", "at", "tf", "n_docs", "n_terms"])

        for doc_ids, texts in by_column(batches, "doc_id", "text"):
            for doc_id, text in zip(doc_ids.to_pylist(), as_bytes(texts)):
                found = lower_words(text)
                n_docs, n_terms = n_docs + (len(found) > 0), n_terms + len(found)
                known = [t for t in map(get, found) if t is not None]
                if known:
                    t, c = np.unique(known, return_counts=True)
                    ids.append(doc_id)
                    lengths.append(len(found))
                    terms.append(t)
                    counts.append(c)
                    held += len(t)
                if len(ids) >= shard_docs or held >= shard_postings:
                    yield shard()
                    for x in (ids, lengths, terms, counts):
                        x.clear()
                    n_docs = n_terms = held = 0
        if n_docs:
            yield shard()

    return docs.mapInArrow(run, SHARD)


class Heap:
    """The best k documents of a query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.doc, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """No document with a score below this is among the best; a score of 0 never is."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def push(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def wand(postings: list[tuple[int, np.ndarray, np.ndarray]], ids: np.ndarray, null: np.ndarray, heap: Heap, window: int = WINDOW) -> int:
    """Pushes what a shard has for one query; how many documents were scored.

    postings: of each term the largest impact, the places of its documents in ascending order, and its impacts on them, all times its weight.
    """
    cursor = [0] * len(postings)
    scored = 0
    while True:
        live = sorted((int(p[1][c]), k) for k, (p, c) in enumerate(zip(postings, cursor)) if c < len(p[1]))
        bound, pivot, least = 0, -1, heap.least
        for at, k in live:
            bound += postings[k][0]
            if bound >= least:
                pivot = at
                break
        if pivot < 0:
            return scored
        bounds, end = np.zeros(window, np.int64), pivot + window
        inside = []
        for at, k in live:
            if at >= end:
                break
            most, places, impacts = postings[k]
            # All before the pivot is skipped.
            a = cursor[k] if at >= pivot else cursor[k] + int(np.searchsorted(places[cursor[k] :], pivot))
            b = a + int(np.searchsorted(places[a:], end))
            cursor[k] = b
            if b > a:
                here = places[a:b] - pivot
                bounds[here] += most
                inside.append((here, impacts[a:b]))
        able = bounds >= least
        if able.any():
            scores = np.zeros(window, np.int64)
            for here, impact in inside:
                scores[here] += impact
            scored += int(able.sum())
            found = np.flatnonzero(able & (scores >= least))
            if len(found):
                heap.push(scores[found], ids[found + pivot], null[found + pivot])


def _weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _shared(n: int, n_terms: int, n_docs: int) -> int:
    """A document's m, from its number of terms."""
    return 75 + 25 * n * n_docs // n_terms


def _search(shards: DataFrame, queries: list[dict[int, int]], df: dict[int, int], n_docs: int, n_terms: int, k: int, window: int) -> DataFrame:
    """query (its place in the list), doc_id, score: the best k documents of each task for each query."""
    spark = shards.sparkSession
    weights = {t: w for t, f in df.items() if (w := _weight(n_docs, f)) > 0}  # a term of weight 0 gives nothing
    told = spark.sparkContext.broadcast(([{t: c for t, c in q.items() if t in weights} for q in queries], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = told.value
        heaps = [Heap(k) for _ in wanted]
        for docs, ns, terms, dfs, ats, tfs in by_column(batches, "docs", "n", "term", "df", "at", "tf"):
            for i in range(len(docs)):
                ids = docs[i].values
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                m = np.array([_shared(n, n_terms, n_docs) for n in ns[i].values.to_pylist()], np.int64)
                at, tf = ats[i].values.to_numpy().astype(np.int64), tfs[i].values.to_numpy().astype(np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[at])
                ends = np.cumsum(dfs[i].values.to_numpy())
                lists_ = {}
                for t, b, f in zip(terms[i].values.to_pylist(), ends.tolist(), dfs[i].values.to_pylist()):
                    if t in weight:
                        x = impact[b - f : b] * weight[t]
                        lists_[t] = (int(x.max()), at[b - f : b], x)
                for q, heap in zip(wanted, heaps):
                    own = [(p[0] * c, p[1], p[2] * c if c > 1 else p[2]) for t, c in q.items() if (p := lists_.get(t))]
                    if own:
                        wand(own, ids, null, heap, window)
        out = [(i, None if null else int(d), int(s)) for i, h in enumerate(heaps) for s, d, null in zip(h.score, h.doc, h.null)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    return shards.mapInArrow(run, "query int, doc_id long, score long")


def _blocks(items: DataFrame, block_terms: int) -> DataFrame:
    """item_id, key, terms (their number), text, block: different rows of the items, each in a block of so many terms or alone in one."""
    i = written(items.distinct().withColumn("key", F.xxhash64("text")))
    size = F.length(F.coalesce("text", F.lit(""))) / 2 + 1  # never fewer than the terms
    n = 1
    while True:
        dealt = i.withColumn("block", F.pmod(F.xxhash64("item_id", "key"), F.lit(n)))
        if dealt.groupBy("block").agg(F.sum(size).alias("size"), F.count("*").alias("n")).where((F.col("size") > block_terms) & (F.col("n") > 1)).isEmpty():
            return dealt
        n *= 2


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS, window: int = WINDOW, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, ties to the smaller doc_id, null last.

    Null and empty texts have no terms: such a document is found nowhere and does not count, such an item finds nothing. Repeated rows of docs are
    documents of their own; they all count, and each has a rank. Exact repeats of an item are one item; other rows that share an id (or have
    none) are searched and ranked apart. A very long text is one row of a shard. An empty table on either side gives no rows. Other
    columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")), block_terms)
    numbers = sorted(r["block"] for r in blocks.select("block").distinct().collect())
    out, id_type = None, blocks.schema["item_id"].dataType.simpleString()
    for number in numbers:
        part = sorted(blocks.where(F.col("block") == number).select("item_id", "key", "text").collect(), key=lambda r: (str(r["item_id"]), r["key"]))
        vocabulary: dict[bytes, int] = {}
        queries = [dict(Counter(vocabulary.setdefault(w, len(vocabulary)) for w in lower_words((r["text"] or "").encode()))) for r in part]
        shards = written(_index(d, vocabulary, shard_docs, shard_postings))
        n_docs, n_terms = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).head())
        each = shards.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
        df = {r["term"]: r["df"] for r in each.collect()}  # no more than the block's terms
        best = written(_search(shards, queries, df, n_docs, n_terms, k, window))
        forget(shards)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], f"query int, item_id {id_type}")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")  # a block's queries
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
