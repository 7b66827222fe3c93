"""Approximate nearest neighbours by randomly rotated one-bit codes (RaBitQ; Gao and Long, 2024).

A unit vector o is rotated and each coordinate kept as its sign: the code is the corner c of a cube, scaled to length one.
The inner product with a query q is estimated as <c, q> / <c, o>; <c, o> is the stored correction scalar. <c, q> is
counted on packed bits: the rotated query is rounded to PLANES bits a coordinate, and each bit plane is met with the code by AND and a count
of ones. The error of the estimate is at most EPSILON * sqrt((1 - <c, o>^2) / <c, o>^2 / (D - 1)) for nearly all vectors, and what
rounding the query adds, which is known.

Every vector is indexed. Queries meet codes, never vectors, block by block:

1. Of all codes the SEEDS * k with the largest estimates are chosen for each query; their vectors are fetched, and the k-th best
   cosine among them is a bar that the k nearest reach.
2. Codes whose estimate plus bound reaches the bar survive. Blocks of vectors in which a query block has a survivor are fetched, and only the survivors' cosines are
   computed.

A group holds one query block and the codes of one cell, or one query block and one block of vectors, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm._common import by_column, written

#: Bound of the estimate's error in standard deviations; bits of a rounded query's coordinate; vectors and queries in a block; vectors in a cell; cells at least; seeds for each neighbour.
EPSILON, PLANES, BLOCK, QUERY_BLOCK, CELL_ROWS, CELLS, SEEDS = 3.5, 6, 2048, 1024, 65536, 24, 4


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of each rotated row, packed into 64-bit words, and its correction scalar <c, o>."""
    turned = unit @ turn.T
    bits = np.zeros((len(unit), -(-unit.shape[1] // 64) * 64), bool)
    bits[:, : unit.shape[1]] = turned > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


class Rounded:
    """Rotated queries as PLANES bit planes, packed as codes are."""

    def __init__(self, turned: np.ndarray):
        n, d = turned.shape
        self.d, self.low = d, turned.min(axis=1, keepdims=True)
        self.step = np.maximum((turned.max(axis=1, keepdims=True) - self.low) / ((1 << PLANES) - 1), 1e-300)
        levels = np.rint((turned - self.low) / self.step).astype(np.int64)
        held = self.low + self.step * levels
        self.total, self.error = held.sum(axis=1, keepdims=True), np.abs(turned - held).sum(axis=1, keepdims=True) / np.sqrt(d)
        bits = np.zeros((PLANES, n, -(-d // 64) * 64), bool)
        for b in range(PLANES):
            bits[b, :, :d] = levels >> b & 1
        self.planes = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)

    def estimate(self, codes: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries by codes), and the bounds of their errors."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)[None]
        met = np.zeros((self.planes.shape[1], len(codes)), np.int32)
        for b in range(PLANES):
            for w in range(codes.shape[1]):
                met += np.bitwise_count(self.planes[b, :, w, None] & codes[None, :, w]).astype(np.int32) << b
        corner = 2 * (self.low * ones + self.step * met) - self.total
        bound = EPSILON * np.sqrt(np.maximum(1 - scalar**2, 0) / scalar**2 / max(1, self.d - 1)) + self.error / scalar
        return corner / np.sqrt(self.d) / scalar, bound


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """In double precision, summed in order."""
    return float(np.cumsum(x * y)[-1] / np.sqrt(np.cumsum(x * x)[-1] * np.cumsum(y * y)[-1]))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are usable vectors of one length, as doubles, and their positions."""
    rows, at = [], []
    for i, x in enumerate(column):
        v = x.as_py()
        if v and None not in v:
            v = np.array(v, float)
            if np.isfinite(v).all() and v.any():
                rows.append(v)
                at.append(i)
    return (np.stack(rows) if rows else np.empty((0, 0))), np.array(at, int)


INDEX = "n int, d int, ids binary, codes binary, scalars binary, vectors binary"


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11, size: int | None = None) -> DataFrame:
    """Blocks of at most ``size`` (BLOCK) vectors of one length: ids, packed codes, correction scalars and the original vectors.

    Vectors that are null, empty or zero, or hold null or non-finite components, are left out, as are null ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        most = size or BLOCK
        for ids, column in by_column(batches, "id", "v"):
            ids = ids.to_numpy(zero_copy_only=False)
            parts: dict[int, list[int]] = {}
            lengths = [0 if x is None else x for x in column.value_lengths().to_pylist()]
            for i, n in enumerate(lengths):
                parts.setdefault(n, []).append(i)
            for d, rows in parts.items():
                if not d:
                    continue
                for at in range(0, len(rows), most):
                    take = np.array(rows[at : at + most])
                    part = column.take(pa.array(take))
                    if part.null_count == 0 and part.flatten().null_count == 0:
                        x = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                        x, take = x[good], take[good]
                    else:
                        x, good = _matrix(part)
                        take = take[good]
                    if not len(take):
                        continue
                    turn = turns.setdefault(d, rotation(d, seed))
                    big = np.abs(x).max(axis=1, keepdims=True)
                    unit = (x / big) / np.linalg.norm(x / big, axis=1, keepdims=True)
                    codes, scalar = encode(unit, turn)
                    own = ids[take].astype(np.int64)
                    row = [len(own), d, own.tobytes(), codes.tobytes(), scalar.tobytes(), x.tobytes()]
                    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["n", "d", "ids", "codes", "scalars", "vectors"])

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return source.mapInArrow(run, INDEX)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def _rows(blob: bytes, d: int) -> np.ndarray:
    return np.frombuffer(blob, float).reshape(-1, d)


#: The pairs of a query block's queries and a block's vectors that are to meet (``_packed``).
WANTED = "q int, d int, block long, pairs binary"


def _packed(i: np.ndarray, j: np.ndarray) -> bytes:
    """Pairs of places: a byte of 0, and int32 by pair."""
    return b"\0" + np.stack([i, j], axis=1).astype(np.int32).tobytes()


def _packed_of(keep: np.ndarray) -> bytes:
    """The pairs that a matrix of queries by vectors marks: listed while few, else a byte of 1 and a bit by vector, each query's in whole bytes."""
    if 64 * np.count_nonzero(keep) < keep.size:
        return _packed(*np.nonzero(keep))
    return b"\1" + np.packbits(keep, axis=1, bitorder="little").tobytes()


def _by_query(pairs: bytes, m: int) -> Iterator[tuple[int, np.ndarray]]:
    """A query's place and those of its vectors, of m, query by query."""
    if pairs[0]:
        for n, bits in enumerate(np.frombuffer(pairs, np.uint8, offset=1).reshape(-1, -(-m // 8))):
            if bits.any():
                yield n, np.flatnonzero(np.unpackbits(bits, count=m, bitorder="little"))
        return
    i, j = np.frombuffer(pairs, np.int32, offset=1).reshape(-1, 2).T
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])[: len(i)])
    for a, b in zip(starts, [*starts[1:], len(i)]):
        yield int(i[a]), j[a:b]


def _scan(cell: pa.Table, k: int, seed: int, bars: bool) -> Iterator[tuple]:
    """What is to be fetched, QUERY_BLOCK queries at a time: (q, d, block, packed pairs) of all that reach their query's bar; or each query's seeds in the cell, as
    (q, d, block, places of queries, places of vectors, estimates)."""
    rows = cell.to_pylist()
    blocks = sorted((r for r in rows if not r["is_query"]), key=lambda r: r["block"])
    for q in (r for r in rows if r["is_query"]):
        d, every = q["d"], _ids(q["ids"])
        turned = _unit(_rows(q["vectors"], d)) @ rotation(d, seed).T
        cuts = [(at, Rounded(turned[at : at + QUERY_BLOCK]), every[at : at + QUERY_BLOCK]) for at in range(0, len(every), QUERY_BLOCK)]
        mine = [(n, _ids(b["ids"]), np.frombuffer(b["codes"], np.uint64).reshape(b["n"], -1), np.frombuffer(b["scalars"], float)) for n, b in enumerate(blocks) if b["d"] == d]
        if bars:
            bar = np.frombuffer(q["bars"], float)[:, None]
            for n, ids, codes, scalars in mine:
                keep = np.empty((len(every), len(ids)), bool)
                for at, asked, own in cuts:
                    est, bound = asked.estimate(codes, scalars)
                    keep[at : at + len(own)] = (est + bound >= bar[at : at + len(own)]) & (ids[None] != own[:, None])
                if keep.any():
                    yield q["q"], d, blocks[n]["block"], _packed_of(keep)
            continue
        for at, asked, own in cuts:
            best = np.full((len(own), 0), -np.inf)
            place = np.empty((len(own), 0), np.int64)  # block's number in this cell and place in it
            for n, ids, codes, scalars in mine:
                est = asked.estimate(codes, scalars)[0]
                est[ids[None] == own[:, None]] = -np.inf
                best = np.concatenate([best, est], axis=1)
                place = np.concatenate([place, np.broadcast_to((n << 32) + np.arange(len(ids)), est.shape)], axis=1)
                if best.shape[1] > SEEDS * k:
                    top = np.argpartition(-best, SEEDS * k - 1, axis=1)[:, : SEEDS * k]
                    best, place = np.take_along_axis(best, top, 1), np.take_along_axis(place, top, 1)
            i, j = np.nonzero(np.isfinite(best))
            found = place[i, j]
            for n in np.unique(found >> 32):
                here = found >> 32 == n
                yield q["q"], d, blocks[n]["block"], at + i[here], found[here] & 0xFFFFFFFF, best[i, j][here]


FOUND = "query_id long, vec_id long, score double, q int, d int, at int"


def _cosines(wanted: DataFrame, asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """FOUND: the k best of the wanted pairs of each query in each block, by their vectors. Only blocks with a pair are fetched."""
    both = wanted.join(asked.select("q", "d", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), ["q", "d"]).join(vectors, "block")

    def run(group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for r in group.to_pylist():
            d = r["d"]
            q_ids, ids, qx, x = _ids(r["q_ids"]), _ids(r["ids"]), _rows(r["q_vectors"], d), _rows(r["vectors"], d)
            q_unit, unit = _unit(qx), _unit(x)
            for at, take in _by_query(r["pairs"], len(ids)):
                s = unit[take] @ q_unit[at]
                # Scores that differ by rounding only are ties here, and go to the smaller id; a repeated row counts once.
                rank = np.lexsort((ids[take], -np.round(s, 12)))
                key = list(zip(ids[take][rank].tolist(), np.round(s[rank], 12).tolist()))
                new = [n for n, v in enumerate(key) if not n or v != key[n - 1]][:k]
                out += [(int(q_ids[at]), key[n][0], cosine(qx[at], x[take[rank[n]]]), r["q"], d, int(at)) for n in new]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    return both.groupBy("q", "block").applyInArrow(run, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine, in double precision, ties to the smaller id.

    A vector is not its own neighbour, nor are other rows of its id. Unusable vectors take no part, as query or candidate. Vectors of different
    lengths do not meet. Repeated rows, of one id and vector, count once; rows of one id with other vectors are candidates of their own.
    """
    base = written(index(vectors, id_col, vector_col, seed).withColumn("block", F.monotonically_increasing_id()))
    few = written(index(queries, id_col, vector_col, seed, max(1, QUERY_BLOCK // 16)))  # small blocks, so that each of the larger ones gets about as many
    size, told = base.agg(F.count("*").alias("b"), F.sum("n").alias("n")).head(), few.agg(F.sum("n")).head()
    q_blocks = max(1, -(-(told[0] or 0) // QUERY_BLOCK))
    cells = max(1, min(size["b"], max(CELLS, -(-(size["n"] or 0) // CELL_ROWS))))

    def gather(group: pa.Table) -> pa.Table:
        """The queries of a block in one row, in the order of their ids."""
        d = group["d"][0].as_py()
        ids, x = np.concatenate([_ids(v) for v in group["ids"].to_pylist()]), np.concatenate([_rows(v, d) for v in group["vectors"].to_pylist()])
        order = np.lexsort((*x.T[::-1], ids))
        return pa.table({"q": group["q"].slice(0, 1), "d": group["d"].slice(0, 1), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([x[order].tobytes()], pa.binary()), "n": pa.array([len(ids)], pa.int32())})

    dealt = few.withColumn("q", F.pmod(F.xxhash64("ids"), F.lit(q_blocks)).cast("int"))
    asked = written(dealt.select("q", "d", "ids", "vectors").groupBy("q", "d").applyInArrow(gather, "q int, d int, ids binary, vectors binary, n int"))
    codes = base.select("block", "d", "n", "ids", "codes", "scalars").withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
    codes = codes.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    nothing = F.lit(None).cast("binary")

    def meeting(asked: DataFrame) -> DataFrame:
        q = asked.select("q", "d", "n", "ids", "vectors", "bars", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
        q = q.select("q", "cell", "d", "ids", "vectors", "bars", F.lit(None).cast("long").alias("block"), "n", nothing.alias("codes"), nothing.alias("scalars"), F.lit(True).alias("is_query"))
        c = codes.select("q", "cell", "d", "ids", nothing.alias("vectors"), nothing.alias("bars"), "block", "n", "codes", "scalars", F.lit(False).alias("is_query"))
        return q.unionByName(c).groupBy("q", "cell")

    def seeds(cell: pa.Table) -> pa.Table:
        rows = [(q, d, b, int(x), int(y), float(e)) for q, d, b, i, j, est in _scan(cell, k, seed, False) for x, y, e in zip(i, j, est)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["q", "d", "block", "at", "place", "est"])

    def survivors(cell: pa.Table) -> pa.Table:
        rows = list(_scan(cell, k, seed, True))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["q", "d", "block", "pairs"])

    first = meeting(asked.withColumn("bars", nothing)).applyInArrow(seeds, "q int, d int, block long, at int, place int, est double")
    by_estimate = Window.partitionBy("q", "d", "at").orderBy(F.desc("est"), "block", "place")
    first = first.withColumn("r", F.row_number().over(by_estimate)).where(F.col("r") <= SEEDS * k)

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({c: group[c].slice(0, 1) for c in ("q", "d", "block")} | {"pairs": pa.array([_packed(group["at"].to_numpy(), group["place"].to_numpy())], pa.binary())})

    wanted = written(first.select("q", "d", "block", "at", "place").groupBy("q", "d", "block").applyInArrow(pack, WANTED))  # QUERY_BLOCK * SEEDS * k places at most
    originals = base.select("block", "ids", "vectors")
    known = _cosines(wanted, asked, originals, k).select("q", "d", "at", "vec_id", "score").distinct()
    kth = Window.partitionBy("q", "d", "at").orderBy(F.desc("score"))
    bars = known.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).groupBy("q", "d").agg(F.collect_list(F.struct("at", "score")).alias("b"))  # one for each query of a block

    def told_bars(group: pa.Table) -> pa.Table:
        n = group["n"][0].as_py()
        out = np.full(n, -np.inf)  # without k seeds there is no bar
        for x in group["b"][0].as_py() or []:
            out[x["at"]] = x["score"] - 1e-9
        return group.select(["q", "d", "n", "ids", "vectors"]).append_column("bars", pa.array([out.tobytes()], pa.binary()))

    barred = written(asked.join(bars, ["q", "d"], "left").groupBy("q", "d").applyInArrow(told_bars, "q int, d int, n int, ids binary, vectors binary, bars binary"))
    left = written(meeting(barred).applyInArrow(survivors, WANTED))
    found = _cosines(left, asked, originals, k).select("query_id", "vec_id", "score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)  # k rows a block at most
    return ranked.select("query_id", "rank", "vec_id", "score")
