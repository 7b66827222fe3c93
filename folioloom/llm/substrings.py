"""Substring dedup: repeated passages by compaction of a De Bruijn graph of word k-mers.

An edge of the graph is a window of k words; its ends are the windows' first and last k - 1 words. A window that occurs once
repeats nothing, so only repeated edges matter. They are found in two steps, so that few windows are ever shuffled:

1. Each window has an anchor: the shorter word run inside it of least hash. Equal windows have equal anchors, and
   neighbouring windows mostly share theirs, so a document has few. Windows whose anchor occurs once are unique.
2. The edges of the other windows are joined by hash. Each edge gets its number of occurrences, its earliest source
   coordinate (document, word), and its successor and predecessor if it has only one.

Compaction: edge e is followed by s without a branch if s is e's only successor and e is s's only predecessor; a join of the
edges with themselves tells. Then s occurs right after e wherever e occurs, so a nonbranching path is a run of adjacent earliest
coordinates: edges that nothing leads into so begin the maximal paths (unitigs), edges that lead into nothing end them, and a join pairs the
two. A path is known by its first edge: one join of the first edges with the occurrences gives all places where the whole path repeats. Each place is verified
against the source coordinates by a 128-bit digest of its words; words of later places are removed.

Documents of equal text are one here: its rows but the earliest document's repeat every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm._common import as_bytes, bits_of, by_column, forget, hashes, lists, mixed, window_hashes, written

#: Words of a window and of an anchor: fixed values of the query, and a choice.
WINDOW, ANCHOR = 20, 8


def anchors(words: np.ndarray, k: int, a: int) -> tuple[np.ndarray, np.ndarray]:
    """For each k-word window the place of its anchor (the a-word run of least hash, the first of equals), and the runs' hashes."""
    runs = window_hashes(words, a)
    n, w = len(words) - k + 1, k - a + 1
    if n <= 0:
        return np.empty(0, np.int64), runs
    order = mixed(runs)  # not the words' alphabet decides
    at = np.arange(n)
    best, where = order[:n].copy(), at.copy()
    for j in range(1, w):
        less = order[j : j + n] < best
        best[less] = order[j : j + n][less]
        where[less] = at[less] + j
    return where, runs


def _anchor_rows(docs: DataFrame, k: int, a: int) -> DataFrame:
    """text_key, doc, hs, twice: of each row its anchors' distinct hashes, and whether each was chosen at two places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, column in by_column(batches, "text_key", "doc", "text"):
            found, twice = [], []
            for t in as_bytes(column):
                where, runs = anchors(hashes(t.split()), k, a)
                h, n = np.unique(runs[np.unique(where)], return_counts=True)
                found.append(h)
                twice.append(n > 1)
            lengths = [len(h) for h in found]
            columns = [keys, ids, lists(lengths, pa.array(bits_of(np.concatenate(found)))), lists(lengths, pa.array(np.concatenate(twice)))]
            yield pa.RecordBatch.from_arrays(columns, ["text_key", "doc", "hs", "twice"])

    return docs.mapInArrow(run, "text_key long, doc long, hs array<long>, twice array<boolean>")


#: What an edge has in one text: first place, number of places, least and largest hash of the edges before and after
#: (0: none; as signed numbers, which is how Spark compares them); more: further places.
EDGES = "text_key long, doc long, edge array<long>, place array<int>, n array<int>, before0 array<long>, before1 array<long>, after0 array<long>, after1 array<long>, more_edge array<long>, more_place array<int>"


def _edge_rows(rows: DataFrame, k: int, a: int) -> DataFrame:
    """Of each text its distinct windows whose anchor is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [np.int64, np.int32, np.int32, np.int64, np.int64, np.int64, np.int64]
        for keys, ids, column, repeated in by_column(batches, "text_key", "doc", "text", "repeated"):
            parts: list[list[np.ndarray]] = [[] for _ in kinds]
            more: list[list[np.ndarray]] = [[], []]
            for t, r in zip(as_bytes(column), repeated):
                words = hashes(t.split())
                where, runs = anchors(words, k, a)
                at = np.flatnonzero(np.isin(runs[where], r.values.to_numpy().view(np.uint64)))
                e = bits_of(window_hashes(words, k))
                padded = np.concatenate([[0], e, [0]])
                order = np.argsort(e[at], kind="stable")  # equal edges stay in order of place
                at = at[order]
                own, before, after = e[at], padded[at], padded[at + 2]
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(at) else np.empty(0, np.int64)
                n = np.diff(np.concatenate([new, [len(at)]])) if len(at) else np.empty(0, np.int64)
                ends = [f.reduceat(x, new) if len(at) else x for x in (before, after) for f in (np.minimum, np.maximum)]
                for part, x in zip(parts, (own[new], at[new], n, *ends)):
                    part.append(x)
                rest = np.ones(len(at), bool)
                rest[new] = False
                more[0].append(own[rest])
                more[1].append(at[rest])
            lengths, further = [len(x) for x in parts[0]], [len(x) for x in more[0]]
            flat = [np.concatenate(x).astype(kind) for x, kind in zip(parts + more, [*kinds, np.int64, np.int32])]
            columns = [lists(m, pa.array(x)) for m, x in zip([lengths] * 7 + [further] * 2, flat)]
            yield pa.RecordBatch.from_arrays([keys, ids, *columns], ["text_key", "doc", "edge", "place", "n", "before0", "before1", "after0", "after1", "more_edge", "more_place"])

    return rows.mapInArrow(run, EDGES)


def _paths(edges: DataFrame, distinct_ids: bool) -> DataFrame:
    """edge, length, doc, t, place: each maximal nonbranching path of repeated edges by its first edge, with its earliest place (in text t).

    Two joins compact. The graph's edges are joined with themselves where one follows the other at its earliest place and neither branches:
    an edge that no other leads into so begins a path, one that leads into no other ends it. The n-th beginning of a text and its n-th end are the
    same path's, so the path is their join; its length is the distance.
    """
    flat = edges.select("doc", "text_key", F.explode(F.arrays_zip("edge", "place", "n", "before0", "before1", "after0", "after1")).alias("e")).select("doc", "text_key", "e.*")
    if distinct_ids:  # all primitive, so that it is aggregated in place; a document has one text
        first = [F.min("doc").alias("doc"), F.min_by("text_key", "doc").alias("t"), F.min_by("place", "doc").alias("place")]
    else:
        first = [F.min(F.struct("doc", "place", F.col("text_key").alias("t"))).alias("first")]
    only = [F.when((F.min(f"{x}0") == F.max(f"{x}1")) & (F.min(f"{x}0") != 0), F.min(f"{x}0")).alias(x) for x in ("before", "after")]
    known = flat.groupBy("edge").agg(F.sum("n").alias("n"), *first, *only).where(F.col("n") > 1)
    if not distinct_ids:
        known = known.select("edge", "first.doc", "first.t", "first.place", "before", "after")
    known = written(known.select("edge", "doc", "t", "place", "before", "after"))
    into = known.where(F.col("before").isNotNull()).select("t", "place", F.col("edge").alias("e"), F.col("before").alias("b"))
    out = known.where(F.col("after").isNotNull()).select("t", (F.col("place") + 1).alias("place"), F.col("edge").alias("b"), F.col("after").alias("e"))
    joined = written(into.join(out, ["t", "place", "b", "e"]).select("t", "place", "e", "b"))
    heads = known.join(joined.select("t", "place", F.col("e").alias("edge")), ["t", "place", "edge"], "left_anti").select("t", "doc", "place", "edge")
    tails = known.join(joined.select("t", (F.col("place") - 1).alias("place"), F.col("b").alias("edge")), ["t", "place", "edge"], "left_anti").select("t", F.col("place").alias("last"), F.col("edge").alias("l_edge"))
    nth = lambda *order: F.row_number().over(Window.partitionBy("t").orderBy(*order))  # noqa: E731  the paths of one text
    heads, tails = heads.withColumn("path", nth("place", "edge")), tails.withColumn("path", nth("last", "l_edge"))
    paths = written(heads.join(tails, ["t", "path"]).select("edge", "doc", "t", "place", (F.col("last") - F.col("place") + 1).cast("long").alias("length")))
    forget(known, joined)
    return paths


def _places(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """path (first edge), text_key, place, length, source: all places of all paths, source being the earliest."""
    first = edges.select("text_key", "doc", F.explode(F.arrays_zip("edge", "place")).alias("e")).select("text_key", "doc", "e.edge", "e.place")
    rest = F.arrays_zip(F.col("more_edge").alias("edge"), F.col("more_place").alias("place"))
    more = edges.select("text_key", "doc", F.explode(rest).alias("e")).select("text_key", "doc", "e.edge", "e.place")
    heads = paths.select("edge", "length", F.col("doc").alias("s_doc"), F.col("t").alias("s_text"), F.col("place").alias("s_place"))
    source = (F.col("doc") == F.col("s_doc")) & (F.col("text_key") == F.col("s_text")) & (F.col("place") == F.col("s_place"))
    return first.unionByName(more).join(heads, "edge").select(F.col("edge").alias("path"), "text_key", "place", "length", source.alias("source"))


def _removed(n: int, starts: tuple[int, ...], sizes: tuple[int, ...]) -> np.ndarray:
    """Which of n words the spans cover."""
    step = np.zeros(n + 1, np.int64)
    starts, sizes = np.asarray(starts), np.asarray(sizes)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + sizes, -1)
    return np.cumsum(step)[:n] > 0


RESULT = "doc_id long, text_key long, n_words long, n_removed long, kept string, kept_sha256 string, removed array<struct<start:int,words:int>>, path array<long>, place array<int>, digest array<binary>, source array<boolean>"


def _cut(rows: DataFrame, k: int, with_text: bool) -> DataFrame:
    """Each row's words without its spans, and the digests of all its places for verification.

    places: path, place, length, source; copy: the text is that of an earlier document, and all its windows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, column, places, copies in by_column(batches, "doc_id", "text_key", "text", "places", "copy"):
            out = []
            for t, spans, copy in zip(as_bytes(column), places.to_pylist(), copies.to_pylist()):
                words = t.split()
                if copy:
                    spans, gone = [], [(0, len(words))] if len(words) >= k else []
                else:
                    spans = spans or []
                    gone = [(s["place"], s["length"] + k - 1) for s in spans if not s["source"]]
                digests = [xxhash.xxh3_128_digest(b" ".join(words[s["place"] : s["place"] + s["length"] + k - 1])) for s in spans]
                kept = words
                if gone:
                    off = _removed(len(words), *zip(*gone))
                    kept = [w for w, o in zip(words, off.tolist()) if not o]
                    gone = [{"start": int(a), "words": int(b - a)} for a, b in np.flatnonzero(np.diff(np.concatenate([[0], off.view(np.int8), [0]]))).reshape(-1, 2)]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), text.decode() if with_text else None, hashlib.sha256(text).hexdigest(), gone, [s["path"] for s in spans], [s["place"] for s in spans], digests, [s["source"] for s in spans]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.bool_())]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([ids, keys, *columns], ["doc_id", "text_key", "n_words", "n_removed", "kept", "kept_sha256", "removed", "path", "place", "digest", "source"])

    return rows.mapInArrow(run, RESULT)


def dedup(docs: DataFrame, k: int = WINDOW, a: int = ANCHOR, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (spans of words), kept (the text left, if asked): one row for each of docs.

    A word goes if a window of k words over it starts earlier too: in a smaller doc_id, or before in the same one. A null id is
    larger than all others; null text has no words. Rows of one id are one document: exact repeats of a row are not earlier
    than it, and lose the same words. A text of fewer than k words loses none, a very long one is read whole. An empty table gives no
    rows. Other columns of docs are left out, whatever their names.
    """
    if not 1 <= a <= k:
        raise ValueError("an anchor has 1 to k words")
    largest = (1 << 63) - 1
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(largest)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")

    found = written(_anchor_rows(d.select("text_key", "doc", "text"), k, a))
    first = written(found.groupBy("text_key").agg(F.min("doc").alias("first_doc")))
    ids = found.groupBy("doc").agg(F.min("text_key").alias("t0"), F.max("text_key").alias("t1")).where(F.col("t0") != F.col("t1"))
    distinct_ids = ids.isEmpty()
    repeats = written(found.groupBy("text_key", "doc").agg(F.count("*").alias("n")).where("n > 1"))
    flat = found.select("text_key", F.explode(F.arrays_zip("hs", "twice")).alias("x")).select("text_key", F.col("x.hs").alias("h"), F.col("x.twice").alias("twice"))
    many = flat.groupBy("h").agg(F.min("text_key").alias("t0"), F.max("text_key").alias("t1"), F.max("twice").alias("twice"))
    many = many.where(F.col("twice") | (F.col("t0") != F.col("t1"))).select("h")
    repeated = flat.select("text_key", "h").join(many, "h").groupBy("text_key").agg(F.collect_set("h").alias("repeated"))
    repeated = written(repeated.join(first, "text_key").select("text_key", F.col("first_doc").alias("doc"), "repeated"))
    forget(found)

    # A repeated row has its text's edges already. They meet before they are shuffled.
    once = d if repeats.isEmpty() else d.groupBy("text_key", "doc").agg(F.first("text").alias("text"))
    edges = written(_edge_rows(once.join(repeated, ["text_key", "doc"]).select("text_key", "doc", "text", "repeated"), k, a))
    forget(repeated, repeats)
    paths = _paths(edges, distinct_ids)
    places = _places(edges, paths)
    place = F.struct("path", "place", F.col("length").cast("int").alias("length"), "source")
    # All places of a text, from one row of it: no more than it has words.
    of = written(places.groupBy("text_key").agg(F.collect_list(place).alias("places")))
    forget(edges, paths)
    shown = written(first.join(of, "text_key", "left").select(F.col("text_key").alias("f_key"), "first_doc", "places"))
    forget(first, of)

    def cut(shown: DataFrame) -> DataFrame:
        rows = d.join(shown, d["text_key"] == shown["f_key"])
        return _cut(rows.select("doc_id", "text_key", "text", "places", (F.col("doc") != F.col("first_doc")).alias("copy")), k, with_text)

    out = written(cut(shown))
    told = out.select("text_key", F.explode(F.arrays_zip("path", "place", "digest", "source")).alias("x")).select("text_key", "x.*")
    # A path's places have one digest, or its hash is shared by different words: those texts are cut again.
    false = told.groupBy("path").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where(F.col("d0") != F.col("d1")).select("path")
    false = written(false)
    if not false.isEmpty():
        out = _recut(out, shown, told, false, cut)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept")


def _recut(out: DataFrame, shown: DataFrame, told: DataFrame, false: DataFrame, cut) -> DataFrame:
    """Texts with a place of a falsely joined path, cut so that each sequence of words under its hash has a source of its own: its earliest place."""
    places = told.join(false, "path").join(shown.select(F.col("f_key").alias("text_key"), "first_doc"), "text_key")
    earliest = places.groupBy("path", "digest").agg(F.min(F.struct("first_doc", "text_key", "place")).alias("s"))
    sources = earliest.select("path", F.col("s.text_key").alias("text_key"), F.col("s.place").alias("place"), F.lit(True).alias("real"))
    marked = places.select("path", "text_key", "place").join(sources, ["path", "text_key", "place"], "left")
    bad = written(marked.groupBy("text_key").agg(F.collect_set("path").alias("w"), F.collect_list(F.when(F.col("real"), F.struct("path", "place"))).alias("own")))
    own = lambda p: F.exists("own", lambda o: (o["path"] == p["path"]) & (o["place"] == p["place"]))
    told_again = F.transform("places", lambda p: F.struct(p["path"].alias("path"), p["place"].alias("place"), p["length"].alias("length"), F.when(F.array_contains("w", p["path"]), own(p)).otherwise(p["source"]).alias("source")))
    again = shown.join(bad, shown["f_key"] == bad["text_key"]).select("f_key", "first_doc", told_again.alias("places"))
    return out.join(bad, "text_key", "left_anti").unionByName(cut(again))
