"""Suffix-array dedup: bytes of repeated strings, by deep-shallow sorting (Manzini and Ferragina, 2004) of sampled suffixes.

A string of ``length`` bytes has an anchor: the gram inside it of least hash. Equal strings have theirs at the same place, so all that a repeated string
needs is found around anchors that occur twice or more, and only the suffixes that begin at such anchors are sorted, not those at all bytes. What
matters of an anchor's surroundings, its context, is the ``length`` bytes from it on and those before it that can be in a string with this anchor.
Occurrences of an anchor with equal contexts are counted, and their contexts are repeated whole. The other contexts are sorted twice: the bytes from
the anchor on, and the bytes before it, read backwards. Two contexts that share r bytes on one side and l on the other, l + r being ``length`` or
more, repeat these l + r bytes.

Sorting is deep-shallow. Multikey quicksort splits all groups of a block at once by eight bytes at a time, down to a shallow depth. What is still tied has
a long common prefix, and is ordered by a blind trie, which looks at branching bytes only and at one whole string an insertion. Neighbours' common
prefixes come out of both. For each r at which suffixes of a group part, those that share r bytes are looked at in the order of the other side, where the
longest l of each is that of a neighbour.

A group is an anchor's different contexts. One with more than ``hot`` is dealt by ranges of where a string begins before the anchor: strings of a range share
a core, by whose hash the contexts are grouped anew; what surrounds all of them is the range's hull, and those that share it are done. A core that is still shared by
more than ``hot`` has its range parted again, until a range is one string. Counts are combined before they are shuffled, so nothing of the group need meet in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm._common import BASE, bits_of, by_column, forget, lists, mixed, written

#: Bytes of a repeated string: fixed value of the query. Bytes of a gram; most contexts of a group; parts into which a range of beginnings is dealt.
LENGTH, GRAM, HOT, FAN = 400, 32, 32768, 4
#: Bytes to which multikey quicksort goes; contexts sorted in one block; bytes whose anchors are looked for at a time.
SHALLOW, BLOCK, PIECE = 32, 8192, 1 << 17


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` consecutive bytes: a polynomial, put together from ones of doubled length."""
    part, size = data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if gram & size:  # this much more of the gram
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - done)
                out = out[:n] * np.uint64(pow(BASE, size, 1 << 64)) + part[done : done + n]
            done += size
        if done == gram:
            return mixed(out[: len(data) - gram + 1])
        part = part[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + part[size:]
        size *= 2


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places, ascending, and hashes of the anchors of all strings of ``length`` bytes: the first of the grams of least hash in each."""
    places, found = [], []
    width = length - gram + 1
    for start in range(0, len(text) - length + 1, PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - start), start)
        h = _gram_hashes(data, gram)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties go to the first
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            rest = width - size
            least = np.minimum(least[:-rest], least[rest:])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.unique(at[np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))])
        places.append(at + start)
        found.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    where, first = np.unique(np.concatenate(places), return_index=True)
    return where, np.concatenate(found)[first]


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """t1, t2 (the text's key), anchor, ctx (a hash of its context), place: arrays, one row for each of docs."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for t1, t2, column in by_column(batches, "t1", "t2", "text"):
            places, hashes, contexts = [], [], []
            for text in column.to_pylist():
                at, h = anchors(text, length, gram)
                places.append(at)
                hashes.append(h)
                contexts.append(np.fromiter((digest(text[max(0, a - before) : a + length], min(a, before)) for a in at.tolist()), np.uint64, len(at)))
            n = [len(p) for p in places]
            h, c, p = (np.concatenate(x) for x in (hashes, contexts, places))
            columns = [lists(n, pa.array(bits_of(h))), lists(n, pa.array(bits_of(c))), lists(n, pa.array(p.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([t1, t2, *columns], ["t1", "t2", "anchor", "ctx", "place"])

    return docs.mapInArrow(run, "t1 long, t2 long, anchor array<long>, ctx array<long>, place array<int>")


def common_prefix(a: bytes, b: bytes) -> int:
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Indices of the strings in order, and the common prefix of each with the one before it (0 for the first).

    An inner node is [depth, {byte at depth, or -1 at a string's end: node}], a leaf a list of equal strings. An insertion follows branching bytes to some leaf,
    compares with its string, and goes down again to the edge at which the two part.
    """
    root: list | None = None
    for i, s in enumerate(strings):
        if root is None:
            root = [None, [i]]
            continue
        node = root
        while node[0] is not None:
            branches = node[1]
            node = branches.get(s[node[0]] if node[0] < len(s) else -1) or next(iter(branches.values()))
        other = strings[node[1][0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            continue
        own, old = (s[depth] if depth < len(s) else -1), (other[depth] if depth < len(other) else -1)
        parent, node = None, root
        while node[0] is not None and node[0] < depth:
            parent, key = node, s[node[0]]
            node = node[1][key]
        if node[0] == depth:
            node[1][own] = [None, [i]]
        else:
            fork = [depth, {own: [None, [i]], old: node}]
            if parent is None:
                root = fork
            else:
                parent[1][key] = fork
    order, common = [], []
    stack = [(0, root)] if root else []
    while stack:
        shared, node = stack.pop()  # shared with the leaf that came before
        if node[0] is None:
            order += node[1]
            common += [shared] + [len(strings[node[1][0]])] * (len(node[1]) - 1)
        else:
            below = sorted(node[1].items(), reverse=True, key=lambda x: x[0])
            stack += [(node[0], child) for _, child in below[:-1]] + [(shared, below[-1][1])]
    return order, common


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in the order of (group, string), and each one's common prefix with the one before it, -1 at a group's first.

    group: numbers in ascending order.
    """
    n = len(strings)
    order, segment = np.arange(n), group.astype(np.int64).copy()
    common = np.full(n, -1, np.int64)
    # Eight bytes are one symbol. A string that ends within the shallow depth or holds a zero byte would look like a padded one: its group goes to the tries.
    plain = np.fromiter((len(s) >= SHALLOW and b"\0" not in s[:SHALLOW] for s in strings), bool, n)
    whole = np.bincount(group, ~plain) == 0
    data = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, -1) if n else np.empty((0, 1), np.uint64)
    for depth in range(SHALLOW // 8):
        size = np.bincount(segment)
        open_ = np.flatnonzero((size[segment] > 1) & whole[group[order]])
        if not len(open_):
            break
        symbol = data[order[open_], depth].astype(np.uint64)
        moved = np.lexsort((symbol, segment[open_]))
        order[open_] = order[open_[moved]]
        symbol = symbol[moved]
        parted = np.flatnonzero((segment[open_][1:] == segment[open_][:-1]) & (symbol[1:] != symbol[:-1])) + 1
        differ = symbol[parted] ^ symbol[parted - 1]
        equal = np.zeros(len(parted), np.int64)
        for k in range(1, 8):
            equal += (differ >> np.uint64(64 - 8 * k)) == 0
        common[open_[parted]] = 8 * depth + equal
        starts = np.concatenate([[True], segment[1:] != segment[:-1]])
        starts[open_[parted]] = True
        segment = np.cumsum(starts) - 1
    bounds = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]])) if n else np.empty(0, np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            held = order[a:b].copy()
            inner, shared = blind_trie([strings[i] for i in held])
            order[a:b] = held[inner]
            common[a + 1 : b] = shared[1:]
    return order, common


def _least_between(values: np.ndarray):
    """A function of (a, b), a < b: the least of values[a + 1 .. b]."""
    table = [values]
    while 2 ** len(table) <= len(values):
        half = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(table[k][a[m] + 1], table[k][b[m] - 2**k + 1])
        return out

    return least


def extents(lefts: list[bytes], rights: list[bytes], group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """How far each context is repeated before and from its anchor on, by other contexts of its group; 0, 0: nowhere."""
    n = len(lefts)
    l_out, r_out = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by_right, shared = deep_shallow(rights, group)
    by_left, shared_left = deep_shallow([x[::-1] for x in lefts], group)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    least = _least_between(shared_left)
    rank = rank[by_right]
    least_right = max(1, length - max(map(len, lefts), default=0))
    for r in np.unique(shared[shared >= least_right])[::-1].tolist():
        run = np.cumsum(shared < r) - 1
        new = np.zeros(n, bool)
        new[run[shared == r]] = True  # runs that are longer than at the r before; the others have been looked at with less asked of the left
        at = np.flatnonzero(new[run])
        at = at[np.lexsort((rank[at], run[at]))]
        same = np.flatnonzero(run[at][1:] == run[at][:-1])
        a, b = at[same], at[same + 1]
        l = least(rank[a], rank[b])  # noqa: E741
        found = l + r >= length
        for x in (by_right[a[found]], by_right[b[found]]):  # each context once in either
            l_out[x] = np.maximum(l_out[x], l[found])
            r_out[x] = np.maximum(r_out[x], r)
    return l_out, r_out


EXTENT = "anchor long, ctx long, l int, r int"


def _sorted_extents(contexts: DataFrame, length: int) -> DataFrame:
    """anchor, ctx, l, r: the extents of contexts (g1, g2: their group; anchor, ctx, before, after). Groups are sorted in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            group = np.cumsum([0] + [a[:2] != b[:2] for a, b in zip(rows, rows[1:])])
            l, r = extents([x[4] for x in rows], [x[5] for x in rows], group, length)  # noqa: E741
            some = np.flatnonzero(r)
            columns = [pa.array([rows[i][k] for i in some], pa.int64()) for k in (2, 3)] + [pa.array(x[some].astype(np.int32)) for x in (l, r)]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "ctx", "l", "r"])

        for columns in by_column(batches, "g1", "g2", "anchor", "ctx", "before", "after"):
            for row in zip(*(c.to_pylist() for c in columns)):
                if len(held) >= BLOCK and row[:2] != held[-1][:2]:
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return contexts.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(run, EXTENT)


def _contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, ctx, before, after: the bytes of wanted contexts (arrays anchor, ctx, place) of texts."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column, wanted in by_column(batches, "text", "wanted"):
            out = [(w["anchor"], w["ctx"], t[max(0, w["place"] - reach) : w["place"]], t[w["place"] : w["place"] + length]) for t, ws in zip(column.to_pylist(), wanted.to_pylist()) for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["anchor", "ctx", "before", "after"])

    return texts.mapInArrow(run, "anchor long, ctx long, before binary, after binary")


def _parts(a: int, b: int) -> list[tuple[int, int]]:
    """The range a..b, ends included, in FAN parts or as many as it has numbers."""
    step = -(-(b - a + 1) // FAN)
    return [(x, min(x + step - 1, b)) for x in range(a, b + 1, step)]


CORES = "anchor long, ctx long, a int, b int, h1 long, h2 long, u1 long, u2 long"


def _dealt(contexts: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """anchor, ctx, l, r of the contexts of groups that are too large.

    Strings that begin in a range a..b share a core and lie in a hull. Contexts that share a hull repeat all strings of the range: they are done with it,
    and one of them goes on for the others to be compared with. Those that share a core only go on, in a range parted anew if they are many.
    """

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors_, ctx, before, after, lows, highs in by_column(batches, "anchor", "ctx", "before", "after", "a", "b"):
            owner, low, high, inner, outer, there = [], [], [], [], [], []
            for i, (x, y, lo, hi) in enumerate(zip(before.to_pylist(), after.to_pylist(), lows.to_pylist(), highs.to_pylist())):
                for a, b in _parts(lo, hi):
                    if len(x) >= a and len(y) >= length - b:
                        owner.append(i)
                        low.append(a)
                        high.append(b)
                        inner.append(xxhash.xxh3_128_digest(x[len(x) - a :] + y[: length - b]))
                        there.append(len(x) >= b and len(y) >= length - a)
                        outer.append(xxhash.xxh3_128_digest(x[len(x) - b :] + y[: length - a]) if there[-1] else bytes(16))
            h, u = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (inner, outer))
            take, none = pa.array(owner, pa.int64()), ~np.array(there, bool)
            columns = [anchors_.take(take), ctx.take(take), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(u[:, k], mask=none) for k in (0, 1))], [c.split()[0] for c in CORES.split(", ")])

    key, hull = ["anchor", "a", "b", "h1", "h2"], ["anchor", "a", "b", "u1", "u2"]
    open_ = contexts.select("anchor", "ctx", F.lit(0).alias("a"), F.lit(length - gram).alias("b"))
    found = []
    while True:  # as often as the ranges can be parted
        dealt = written(contexts.join(open_, ["anchor", "ctx"]).mapInArrow(cores, CORES))
        classes = written(dealt.where(F.col("u1").isNotNull()).groupBy(*hull).agg(F.count("*").alias("n"), F.min("ctx").alias("first")).where("n > 1").drop("n"))
        marked = written(dealt.join(classes, hull, "left"))
        forget(dealt, classes)
        whole = F.col("first").isNotNull()
        goes_on = marked.where(~whole | (F.col("ctx") == F.col("first")))
        sizes = written(goes_on.groupBy(*key).agg(F.count("*").alias("m"), F.count_if(~whole).alias("left")).where("m > 1 AND left > 0").drop("left"))
        held = written(goes_on.select("ctx", *key).join(sizes, key))
        many = F.col("m") > hot
        few = held.where(~many).select("anchor", "ctx", F.xxhash64("a", "b", "h1", "h2").alias("g2"))
        few = _sorted_extents(contexts.join(few, ["anchor", "ctx"]).select(F.col("anchor").alias("g1"), "g2", "anchor", "ctx", "before", "after"), length)
        found.append(written(marked.where(whole).select("anchor", "ctx", F.col("b").alias("l"), (F.lit(length) - F.col("a")).alias("r")).unionByName(few)))
        open_ = written(held.where(many).select("anchor", "ctx", "a", "b"))
        forget(marked, sizes, held)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, removed array<struct<start:long,bytes:long>>"


def _cut(rows: DataFrame, length: int, gram: int, with_text: bool) -> DataFrame:
    """Each row without what its places cover; twin: there is another row of the same text."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, column, spans, twins in by_column(batches, "doc_id", "text", "spans", "twin"):
            out = []
            for t, found, twin in zip(column.to_pylist(), spans.to_pylist(), twins.to_pylist()):
                gone, at = [], 0
                if twin:
                    gone = [(0, len(t))] if len(t) >= length else []
                else:
                    for s in sorted((max(0, s["place"] - min(s["l"], reach)), min(len(t), s["place"] + s["r"])) for s in found or ()):
                        if gone and s[0] <= gone[-1][1]:
                            gone[-1] = (gone[-1][0], max(gone[-1][1], s[1]))
                        else:
                            gone.append(s)
                kept = []
                for a, b in gone:
                    kept.append(t[at:a])
                    at = b
                rest = b"".join([*kept, t[at:]]) if gone else t
                out.append((len(t), len(t) - len(rest), len(gone), rest if with_text else None, hashlib.sha256(rest).hexdigest(), [{"start": a, "bytes": b - a} for a, b in gone]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "removed"])

    return rows.mapInArrow(run, RESULT)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (spans of bytes), kept (the bytes left, if asked): one row for each of docs.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or another; so the first of several goes
    too, and all of a text of ``length`` bytes or more that another row has as well. Null and empty texts have no bytes; a text under ``length`` bytes
    loses none. Rows of one id, or without an id, are documents of their own. Anchors of a very long text are looked for piece by piece. An empty table
    gives no rows. Other columns are left out, whatever their names. What is kept may begin or end inside a character.
    """
    if not 1 <= gram <= length:
        raise ValueError("a gram has 1 to length bytes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # Two hashes are a text's key.
    d = d.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.col("text").cast("binary").alias("text"))

    found = written(_occurrences(d.select("t1", "t2", "text"), length, gram))
    twins = written(found.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("t1", "t2"))
    flat = found.select("t1", "t2", F.explode(F.arrays_zip("anchor", "ctx", "place")).alias("x")).select("t1", "t2", "x.*")
    known = written(flat.groupBy("anchor").agg(F.count("*").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("n > 1"))  # so that Spark can split a hot anchor's side of the join
    repeated = written(flat.join(known, "anchor").select("t1", "t2", "anchor", "ctx", "place", (F.col("c0") != F.col("c1")).alias("differ")))
    forget(found, known)

    # Of an anchor's different contexts, each with one place that has it.
    each = written(repeated.where("differ").groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "place")).alias("at")))
    wanted = each.select("at.t1", "at.t2", F.struct("anchor", "ctx", "at.place").alias("w")).groupBy("t1", "t2").agg(F.collect_list("w").alias("wanted"))  # no more than a text's anchors
    texts = d.groupBy("t1", "t2").agg(F.first("text").alias("text"))  # copies meet before they are shuffled
    contexts = written(_contexts(texts.join(wanted, ["t1", "t2"]).select("text", "wanted"), length, gram))
    sizes = each.groupBy("anchor").agg(F.count("*").alias("m"))
    large = written(sizes.where(F.col("m") > hot).select("anchor"))
    if large.isEmpty():
        shared = written(_sorted_extents(contexts.select(F.col("anchor").alias("g1"), F.lit(0).cast("long").alias("g2"), "*"), length))
    else:
        usual = contexts.join(large, "anchor", "left_anti").select(F.col("anchor").alias("g1"), F.lit(0).cast("long").alias("g2"), "*")
        dealt = _dealt(written(contexts.join(large, "anchor", "left_semi")), length, gram, hot)
        shared = written(_sorted_extents(usual, length).unionByName(dealt))
    forget(contexts, large)

    extent = shared.groupBy("anchor", "ctx").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    whole = [F.lit(length).alias("l"), F.lit(length).alias("r")]  # cut to the context where it is used
    of = each.where("n > 1").select("anchor", "ctx", *whole).unionByName(each.where("n = 1").select("anchor", "ctx").join(extent, ["anchor", "ctx"]))
    single = repeated.join(twins, ["t1", "t2"], "left_anti")
    places = single.where("NOT differ").select("t1", "t2", "place", *whole).unionByName(single.where("differ").join(of, ["anchor", "ctx"]).select("t1", "t2", "place", "l", "r"))
    spans = written(places.groupBy("t1", "t2").agg(F.collect_list(F.struct("place", "l", "r")).alias("spans")))  # no more than a text's anchors: it is in one row
    forget(each, shared, repeated)
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    shown = spans.withColumn("twin", F.lit(False)).unionByName(twins.select("t1", "t2", none.alias("spans"), F.lit(True).alias("twin")))
    rows = d.join(shown, ["t1", "t2"], "left").select("doc_id", "text", "spans", F.coalesce("twin", F.lit(False)).alias("twin"))
    return _cut(rows, length, gram, with_text).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")
