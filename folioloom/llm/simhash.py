"""SimHash fingerprints of word shingles, and all pairs of them within a few differing bits.

A fingerprint's eight bytes are indexed by position. Two fingerprints that differ in at most two bits agree in at least six positional
bytes, the guaranteed minimum, and of the four pairs of neighbouring positions in at least two. So a posting list is keyed by two such
pairs with their four bytes: six lists hold each fingerprint, and each pair that can pass the count filter meets in one at least. In a list the
shared positional bytes of each pair are tallied, four to eight, pairs with fewer than six are dropped, and the rest are verified bit by bit.
(Lists of single bytes would hold a 256th of all fingerprints each, so tallying their pairs would take time quadratic in the input.)

A list of more than LONG fingerprints is dealt again by two more positions that a passing pair must share, in all six ways. Its
members then differ in two bytes only, so that a list has 65,536 at most, however many documents there are, and all have the
minimum; a long one is searched by flipping the bits of those bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm._common import as_bytes, bits_of, by_column, forget, hashes, lists, mixed, trim, window_hashes, written
from folioloom.llm.graph import components

#: A list of four positions with more members than this is dealt again; one of six positions with more members than this is searched by flipping bits.
LONG, SMALL_LIST = 4096, 128


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """64 bits, each 1 if set in over half of the XXH64 values of the shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    h = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    n = len(words) - size + 1
    for at in range(0, n, 65536):  # a very long text takes no more memory than this
        part = words[at : at + 65536 + size - 1]
        hs = np.fromiter((h(b" ".join(s), seed) for s in zip(*(part[j:] for j in range(size)))), np.uint64, len(part) - size + 1)
        total += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long), one row for each of docs, whole texts. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in by_column(batches, "doc_id", "text"):
            fps = np.fromiter((fingerprint(t, size) for t in as_bytes(texts)), np.uint64, len(ids))
            yield pa.RecordBatch.from_arrays([ids, pa.array(bits_of(fps))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(shared: int) -> list[int]:
    """Masks of each set of so many of the eight byte positions."""
    return [sum(0xFF << (8 * p) for p in keep) for keep in combinations(range(8), shared)]


#: Two of the four pairs of neighbouring positions; for each, itself with two of the other four positions.
PAIRED = [sum(0xFFFF << (16 * p) for p in keep) for keep in combinations(range(4), 2)]
DEALT = [[m for m in _masks(6) if m & first == first] for first in PAIRED]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(mask: int, most: int) -> np.ndarray:
    """All ways to flip up to so many of the bits outside a mask."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return np.array([sum(c) for k in range(1, most + 1) for c in combinations(free, k)], np.uint64)


def _linked(fps: np.ndarray, mask: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked members of one list, whose fingerprints, sorted and distinct, agree in the mask."""
    out = []
    if len(fps) <= SMALL_LIST or mask.bit_count() < 8 * (8 - most):
        for i, j in _rows_of_pairs(len(fps)):
            x = fps[i] ^ fps[j]
            i, j, x = (v[(x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - most] for v in (i, j, x))
            keep = np.bitwise_count(x) <= most
            if keep.any():
                out.append((i[keep], j[keep]))
        return out
    for flip in _flips(mask, most):
        there = np.searchsorted(fps, fps ^ flip)
        there[there == len(fps)] = 0
        i = np.flatnonzero((fps[there] == fps ^ flip) & (np.arange(len(fps)) < there))
        if len(i):
            out.append((i, there[i]))
    return out


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n members the least one it is linked with, through others too."""
    label = np.arange(n)
    while True:
        old = label.copy()
        for i, j in pairs:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if (label == old).all():
            return label


def links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """a > b: links between fingerprints (column fp, distinct) that join the same ones as all pairs within ``most`` bits.

    Of a list's linked pairs a spanning forest is returned, so a dense group costs no more rows than it has members.
    """
    if not 1 <= most <= 2:
        raise ValueError("most is 1 or 2: with more differing bits a posting list has no bound")
    masks = PAIRED + [m for some in DEALT for m in some]
    key = lambda i, m: F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
    listed = distinct.select("fp", F.explode(F.array(*[key(i, m) for i, m in enumerate(PAIRED)])).alias("p")).select("p.s", "p.k", "fp")
    long = written(listed.groupBy("s", "k").agg(F.count("*").alias("m")).where(F.col("m") > LONG).select("s", "k"))
    if long.isEmpty():
        postings = listed
    else:
        again = [F.when(F.col("s") == i, F.array(*[key(len(PAIRED) + len(PAIRED) * i + j, m) for j, m in enumerate(some)])) for i, some in enumerate(DEALT)]
        again = listed.join(long, ["s", "k"], "left_semi").select("fp", F.explode(F.coalesce(*again)).alias("p")).select("p.s", "p.k", "fp")
        postings = listed.join(long, ["s", "k"], "left_anti").unionByName(again)
    dealt = postings.repartition("s", "k").sortWithinPartitions("s", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def lists(s, k, fp):
            """Links of whole lists."""
            new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])]))
            n = np.diff(np.concatenate([new, [len(s)]]))
            a, b = [], []
            for at, m in zip(new[n > 1], n[n > 1]):
                members = np.unique(fp[at : at + m].view(np.uint64))
                pairs = _linked(members, masks[s[at]], most)
                root = _forest(len(members), pairs)
                up = np.flatnonzero(root != np.arange(len(members)))
                a.append(members[up])
                b.append(members[root[up]])
            if a:
                a, b = bits_of(np.concatenate(a)), bits_of(np.concatenate(b))
                return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])
            return None

        for cols in by_column(batches, "s", "k", "fp"):
            now = [c.to_numpy(zero_copy_only=False) for c in cols]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            s, k, _ = now
            last = np.flatnonzero((s != s[-1]) | (k != k[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last list may go on in the next batch
            held = [x[cut:] for x in now]
            if cut and (out := lists(*(x[:cut] for x in now))) is not None:
                yield out
        if held is not None and (out := lists(*held)) is not None:
            yield out

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: each document with the least doc_id it reaches through links of at most ``most`` bits.

    Equal fingerprints are one class, so copies are never expanded into pairs. Texts without words share fingerprint 0.
    A null doc_id takes part but names a component only if all its documents have none. Repeated rows stay repeated. A very long text is read
    whole, an empty table gives no rows, and other columns are left out, whatever their names.
    """
    fps = written(fingerprints(docs, size, id_col, text_col))
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(links(classes.select("fp"), most))
    rooted = written(classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# Near copies by the similarity of their texts. Documents that share 0.8 of their five-word shingles differ in many more than
# two bits of a fingerprint. A fingerprint four times as wide, of the set of words, finds most of them; a prefix filter on the shingles
# themselves then finds every pair that is left between two groups, so the number of KEYS decides how much is left to it, not what is found.

#: Bytes of a wide fingerprint; byte positions in a key of the index, and keys of a document; shared bytes and differing
#: bits a candidate must reach; words of a shingle and the least Jaccard similarity.
WIDE, KEY_BYTES, KEYS, LEAST_BYTES, MOST_BITS, SHINGLE, SIMILAR = 32, 5, 24, 6, 40, 5, 0.8
#: Texts in which frequent shingles are looked for, how many must hold one, and how many shingles there are at most. They come
#: last in the prefix filter's order; any choice of them loses no pair.
SAMPLE, HELD_BY, FREQUENT = 50_000, 3, 100_000
#: Members of a block of a long list.
LIST = 256


def wide_fingerprint(words: list[bytes]) -> np.ndarray:
    """32 bytes: each bit 1 if set in over half of the hashes of the distinct words."""
    h = hashes(sorted(set(words)))
    total = np.zeros(8 * WIDE, np.int64)
    for at in range(0, len(h), 16384):
        part = h[at : at + 16384]
        bits = np.stack([mixed(part + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for i in range(WIDE // 8)], axis=1)
        total += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(h), bitorder="little")


def _key_positions() -> np.ndarray:
    """For each key the byte positions whose bytes it holds: the same ones for all documents."""
    rng = np.random.default_rng(5)
    return np.stack([np.sort(rng.choice(WIDE, KEY_BYTES, replace=False)) for _ in range(KEYS)])


def similarity(a: list[bytes], b: list[bytes], size: int = SHINGLE) -> float:
    """Jaccard similarity of the sets of shingles; fewer words than a shingle's are one shingle."""

    def shingles(w: list[bytes]) -> set:
        return set(zip(*(w[j:] for j in range(size)))) if len(w) >= size else {tuple(w)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles that ``similarity`` compares."""
    return np.unique(window_hashes(hashes(words), size) if len(words) >= size else hashes([b" ".join(words)]))


Frequent = tuple[np.ndarray, np.ndarray]


def prefix(h: np.ndarray, similar: float, frequent: Frequent) -> np.ndarray:
    """The first of h (sorted, distinct), rare ones first, of which a set of similarity ``similar`` or more shares at least one among its own.

    frequent: sorted hashes and how often each was seen; others are rarer than all of them.
    """
    order = np.zeros(len(h), np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], h), len(frequent[0]) - 1)
        order = np.where(frequent[0][at] == h, frequent[1][at], 0)
    return h[np.argsort(order, kind="stable")][: len(h) - int(np.ceil(similar * len(h) - 1e-9)) + 1]


def _frequent(d: DataFrame, size: int) -> Frequent:
    """Shingles that HELD_BY or more of a sample of texts hold, the FREQUENT most frequent, and how many hold each."""
    step = max(1, -(-d.count() // SAMPLE))
    sample = d.where(F.pmod("row_key", F.lit(step)) == 0).select("row_key", "text").dropDuplicates(["row_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in by_column(batches, "text"):
            for t in as_bytes(texts):
                yield pa.RecordBatch.from_arrays([pa.array(bits_of(shingle_hashes(t.lower().split(), size)))], ["h"])

    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= HELD_BY)
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top.column("n").to_numpy().astype(np.int64)[order]


def _list_pairs(lists: DataFrame, similar: float) -> DataFrame:
    """a > b: pairs of different roots that a list (h, c, root, n, pos) shows may be similar.

    Sets of sizes x and y of that similarity share m = similar / (1 + similar) * (x + y) shingles or more, so one at least is among the
    first x - m + 1 of the one and the first y - m + 1 of the other. All members of a list meet, and a pair leaves it if pos, the list's
    place in the order of each text, is within these bounds, which are tighter than the prefix for all but the smallest partner: copies of one text that
    are not similar to each other begin with what they do not share. A long list is cut into blocks of about LIST members, and each two
    blocks meet in a cell of their own, so that no task holds a long list.
    """
    columns = ["h", "c", "root", "n", "pos"]
    cuts = lists.groupBy("h").agg(F.ceil(F.count("*") / F.lit(LIST)).cast("int").alias("cuts"))
    cut = lists.select(*columns).join(cuts, "h").withColumn("mine", F.pmod(F.xxhash64("c", "h"), F.col("cuts")).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    columns += ["lo", "hi", "mine"]
    dealt = cells.select(*columns).repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, root, n, pos, lo, hi, mine in _whole_lists(batches, ["h", "lo", "hi"], ["c", "root", "n", "pos", "lo", "hi", "mine"]):
            for i, j in _rows_of_pairs(len(c)):
                shared = np.ceil(similar / (1 + similar) * (n[i] + n[j]) - 1e-6)
                keep = (root[i] != root[j]) & (c[i] != c[j]) & ((mine[i] != mine[j]) | (lo[0] == hi[0])) & (np.minimum(n[i], n[j]) >= shared)
                keep &= (pos[i] <= n[i] - shared) & (pos[j] <= n[j] - shared)
                i, j = i[keep], j[keep]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(c[i], c[j])), pa.array(np.minimum(c[i], c[j]))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _rows_of_pairs(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j under m, some hundred thousand at a time."""
    at = 0
    while at < m - 1:
        to = min(m - 1, at + max(1, 200_000 // (m - at)))
        width = m - 1 - np.arange(at, to)
        i = np.repeat(np.arange(at, to), width)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
        at = to


def _whole_lists(batches: Iterator[pa.RecordBatch], by: list[str], rest: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns ``rest`` of each run of two or more rows that agree in ``by``."""
    held: list[np.ndarray] | None = None

    def lists(now: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        new = np.zeros(len(now[0]), bool)
        new[0] = True
        for x in now[: len(by)]:
            new[1:] |= x[1:] != x[:-1]
        start = np.flatnonzero(new)
        n = np.diff(np.concatenate([start, [len(new)]]))
        for at, m in zip(start[n > 1], n[n > 1]):
            yield [x[at : at + m] for x in now[len(by) :]]

    for cols in by_column(batches, *by, *rest):
        now = [c.to_numpy(zero_copy_only=False) for c in cols]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        last = np.zeros(len(now[0]), bool)
        for x in now[: len(by)]:
            last |= x != x[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # the last list may go on in the next batch
        held = [x[cut:] for x in now]
        if cut:
            yield from lists([x[:cut] for x in now])
    if held is not None:
        yield from lists(held)


def _mixed(lists: DataFrame) -> DataFrame:
    """Rows of lists whose members are not all of one root. Lists are judged by aggregates, so a large group's are never gathered."""
    keys = lists.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    return lists.join(keys, "h", "left_semi")


def near_copies(docs: DataFrame, similar: float = SIMILAR, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, root, least: of each distinct text (row_key is a hash of the column) its group of near copies and their least doc_id.

    Two texts are linked if their lower-case words' ``size``-word shingles have a Jaccard similarity of ``similar`` or more, and
    groups are what links reach. Every link between two groups is found, but for collisions of 64-bit hashes:

    1. Links that the byte-position index of wide fingerprints proposes: each document is listed under KEYS keys of KEY_BYTES positional
       bytes; members of a list are paired in a row and with the first, and pairs short of LEAST_BYTES or with over MOST_BITS
       differing bits are dropped. This loses pairs; it is there to join most of a large group at a cost that grows with its members.
    2. Each text is listed under the shingles of its prefix (``prefix``), by which any two similar texts share a list. Lists within one
       group are dropped. In the others a member of each group is compared with one of the first group.
    3. In the lists that still have members of two groups all pairs of different groups that may be similar (``_list_pairs``) are verified.

    Candidates are verified on the whole texts. Texts of the same words are one class. Null text has no words, like an empty one.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    frequent = _frequent(d, size)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for ids, keys, texts in by_column(batches, "doc_id", "row_key", "text"):
            same, fps, n, firsts = [], [], [], []
            for t in texts.cast(pa.binary()):  # one text's words at a time
                words = (t.as_py() or b"").lower().split()
                hs = shingle_hashes(words, size)
                same.append(h(b" ".join(words)))
                fps.append(wide_fingerprint(words))
                n.append(len(hs))
                firsts.append(bits_of(prefix(hs, similar, frequent)))
            longs = np.ascontiguousarray(np.stack(fps)).view(np.int64)
            listed = lists([len(f) for f in firsts], pa.array(np.concatenate(firsts)))
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(bits_of(np.array(same, np.uint64))), *(pa.array(longs[:, i].copy()) for i in range(4)), pa.array(n, pa.int64()), listed], ["doc_id", "row_key", "c", "f0", "f1", "f2", "f3", "n", "prefix"])
            trim()

    fields = [f"f{i}" for i in range(4)]
    found = written(d.mapInArrow(read, "doc_id long, row_key long, c long, f0 long, f1 long, f2 long, f3 long, n long, prefix array<long>"))
    classes = written(found.groupBy("c").agg(F.min("doc_id").alias("least"), *[F.min(f).alias(f) for f in fields], F.min("n").alias("n"), F.first("prefix").alias("prefix")))
    texts_of = written(found.groupBy("c", "row_key").agg(F.min("doc_id").alias("doc_id")))  # copies are one row before anything is joined
    forget(found)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _key_positions()
        weight = (np.uint64(1) << (np.uint64(8) * np.arange(KEY_BYTES, dtype=np.uint64))).astype(np.uint64)
        for c, *fs in by_column(batches, "c", *fields):
            fp = np.stack([f.to_numpy() for f in fs], axis=1).view(np.uint8).reshape(len(c), WIDE)
            for i in range(KEYS):
                key = (fp[:, at[i]].astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) + (np.uint64(i) << np.uint64(8 * KEY_BYTES))
                yield pa.RecordBatch.from_arrays([pa.array(bits_of(key)), c], ["k", "c"])

    postings = classes.mapInArrow(post, "k long, c long").repartition("k").sortWithinPartitions("k", F.xxhash64("c", "k"), "c")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # of the list that may go on: (key, member)
        for ks, cs in by_column(batches, "k", "c"):
            k, c = ks.to_numpy(), cs.to_numpy()
            if last is not None:
                k, c = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], c])
            same = k[1:] == k[:-1]
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(k)), 0))
            head = c[start]
            if last is not None:
                head[start == 0] = first
            a, b = np.concatenate([c[:-1][same], head[1:][same]]), np.concatenate([c[1:][same]] * 2)
            last, first = (k[-1], c[-1]), head[-1]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    pairs = postings.mapInArrow(pair, "a long, b long").where(F.col("a") > F.col("b")).distinct()
    one, two = (classes.select(F.col("c").alias(x), *[F.col(f).alias(x + f) for f in fields]) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    x = [F.col("a" + f).bitwiseXOR(F.col("b" + f)) for f in fields]
    tally = sum((v.bitwiseAND(F.lit(_signed(0xFF << 8 * j))) == 0).cast("int") for v in x for j in range(8))
    bits = sum(F.bit_count(v) for v in x)
    candidates = written(both.where((tally >= LEAST_BYTES) & (bits <= MOST_BITS)).select("a", "b"))

    def verified(candidates: DataFrame) -> DataFrame:
        """Those of the pairs a, b whose texts are similar."""
        # Of each class in a candidate one text, of its least row; the text is all that is read of the documents again.
        held = candidates.select(F.col("a").alias("c")).unionByName(candidates.select(F.col("b").alias("c"))).distinct()
        keys = texts_of.groupBy("c").agg(F.min("row_key").alias("t_key"), F.min_by("doc_id", "row_key").alias("t_id"))
        keys = written(keys.join(held, "c", "left_semi"))
        texts = d.join(keys, (d["row_key"] == keys["t_key"]) & d["doc_id"].eqNullSafe(keys["t_id"])).select("c", "text").dropDuplicates(["c"])
        texts = written(texts)
        left = candidates.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a")
        left = left.join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b, ta, tb in by_column(batches, "a", "b", "ta", "tb"):
                good = [similarity(u.lower().split(), v.lower().split(), size) >= similar for u, v in zip(as_bytes(ta), as_bytes(tb))]
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        out = written(left.mapInArrow(verify, "a long, b long"))
        forget(candidates, keys, texts)
        return out

    def with_root(rows: DataFrame, links: DataFrame) -> DataFrame:
        comp = components(links)
        return rows.join(comp, rows["c"] == comp["node"], "left").withColumn("root", F.coalesce("root", "c")).drop("node")

    links = verified(candidates)
    rooted = written(with_root(classes.select("c", "n", "prefix"), links))
    listed = rooted.select("c", "root", "n", F.posexplode("prefix").alias("pos", "h")).withColumn("pos", F.col("pos").cast("long"))
    mixed = written(_mixed(listed))
    forget(rooted)

    one = mixed.groupBy("h", "root").agg(F.min(F.struct("c", "n")).alias("m"))
    first = one.groupBy("h").agg(F.min(F.struct("root", "m")).alias("f"))
    met = one.join(first, "h").where(F.col("root") > F.col("f.root"))
    met = met.where((F.least("m.n", "f.m.n") + 1e-6 >= F.greatest("m.n", "f.m.n") * similar))
    ends = [F.col("m.c"), F.col("f.m.c")]
    links = links.unionByName(verified(written(met.select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).distinct())))

    rest = written(_mixed(with_root(mixed.drop("root"), links)))
    forget(mixed)
    links = links.unionByName(verified(written(_list_pairs(rest, similar))))
    forget(rest)
    rooted = written(with_root(classes.select("c", "least"), links))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    named = rooted.select("c", "root").join(least, "root").select("c", "root", "least")
    out = written(texts_of.join(named, "c").select("row_key", "root", "least"))
    forget(classes, texts_of, rooted)
    return out


def keep_one(docs: DataFrame, similar: float = SIMILAR, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One of docs for each group of near copies: that of the least id (null ids last); all columns as they are.

    Of repeated rows of that id in a group one stays. Groups that have the same id, or none, each keep their own.
    """
    groups = near_copies(docs, similar, size, id_col, text_col).select(F.col("row_key").alias("g_key"), "root", "least")
    key = F.xxhash64(F.col(f"row.`{text_col}`").cast("string"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("r_key", key)
    mine = F.col(f"row.`{id_col}`").cast("long")
    joined = rows.join(groups, rows["r_key"] == groups["g_key"]).where(mine.eqNullSafe(F.col("least")))
    # What is left of a group has one id, so ties are its repeated rows.
    return joined.groupBy("root").agg(F.min_by("row", "r_key").alias("row")).select("row.*")
