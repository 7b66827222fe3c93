"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all want the same number of copies, target / source size. Whole copies are given;
the fraction is a probability. Two documents at a time pass probability between them, in proportion to
their words so that the expected words stay what they are, until one of them is 0 or 1. A chunk of documents leaves at
most one open probability, the residual; residuals of chunks meet in larger chunks, up a tree, until a source has one,
which a coin settles. So a source's words miss its target by less than one document's words.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm._common import WORD, written

#: Weights of the sources in code-point order, repeating, and the most copies of a document: fixed values of the query.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Documents in a chunk of the tree, and chunks that meet in one of the next level.
CHUNK, FAN_IN = 128, 64
#: Repeats of a row that are numbered at a time.
REPEATS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares of all words by weight, none above ``most`` times its source's words.

    What a full source cannot take is shared among the others by weight, again and again until none is above.
    The driver gets one row a source (a mix names its sources, so they are few), never documents. Sources are ordered by
    code point, null last.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = sorted(sums.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    size = [float(r["source_size"] or 0) for r in rows]
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    full: set[int] = set()
    total, share = sum(size), [0.0] * len(rows)
    while len(full) < len(rows):
        left = total - sum(most * size[i] for i in full)
        free = sum(weight[i] for i in range(len(rows)) if i not in full)
        over = {i for i in range(len(rows)) if i not in full and left * weight[i] / free > most * size[i]}
        for i in range(len(rows)):
            share[i] = most * size[i] if i in full or i in over else left * weight[i] / free
        if not over:
            break
        full |= over
    return sizes.sparkSession.createDataFrame([(r["source"], int(r["source_size"] or 0), t) for r, t in zip(rows, share)], "source string, source_size long, target double")


def _coin(seed: int, *key) -> float:
    return xxhash.xxh64_intdigest(repr(key).encode(), seed) / 2.0**64


def pivot(keys: list, sizes: list[int], p: list[float], seed: int, last: bool) -> list[float]:
    """Probabilities after passing them on: all 0 or 1 but for one at most, and for none if ``last``."""
    p = list(p)
    held = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * sizes[a], p[b] * sizes[b])  # words that may go to a
        down = min(p[a] * sizes[a], (1 - p[b]) * sizes[b])  # and from it
        give = up if _coin(seed, keys[a], keys[b], p[a], p[b]) * (up + down) < down else -down
        pa_, pb_ = p[a] + give / sizes[a], p[b] - give / sizes[b]
        p[a], p[b] = (0.0 if pa_ < 1e-12 else 1.0 if pa_ > 1 - 1e-12 else pa_), (0.0 if pb_ < 1e-12 else 1.0 if pb_ > 1 - 1e-12 else pb_)
        held = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
    if last and held >= 0:
        p[held] = float(_coin(seed, keys[held], "last") < p[held])
    return p


SCHEMA = "doc_id long, size long, source string, source_size long, target double, place long, whole long, p double, h long, row long, chunk long"


def _level(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    def settle(group: pa.Table) -> pa.Table:
        # The largest first: what is open at the end is then a small document.
        keys = list(zip(group["size"].to_pylist(), group["h"].to_pylist(), group["p"].to_pylist()))
        order = sorted(range(len(keys)), key=lambda i: (-keys[i][0], keys[i][1:]))
        group = group.take(pa.array(order, pa.int64()))
        p = pivot(group["h"].to_pylist(), group["size"].to_pylist(), group["p"].to_pylist(), seed, last)
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return rows.groupBy("place", "chunk").applyInArrow(settle, SCHEMA)


def _row(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(doc_id.cast("long"), text.cast("string"), F.lit(seed))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, source, row (a hash of id and text): one row for each of docs.

    Null text has no words. A document without words takes none. Repeated rows are documents of their own, of which equal
    ones are interchangeable. An empty table gives no rows; a very long text is one document. Other columns are left out, whatever their names. The same rows give the same copies in any partitioning: coins are hashes of ids and texts.
    """
    words = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"),
        # The text too, so that documents without an id, or with one id, are dealt over all chunks.
        _row(F.col(id_col), F.col(text_col), seed).alias("h"),
    )
    # Equal rows are counted, and told apart by a number, so that they are dealt over all chunks too. Numbers are made in two steps: no row holds many.
    counted = words.groupBy("doc_id", "size", "source", "h").agg(F.count("*").alias("n"))
    tens = counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEATS))))
    each = tens.withColumn("nth", F.explode(F.sequence(F.lit(0), F.least(F.col("n") - F.col("part") * REPEATS, F.lit(REPEATS)) - 1)))
    nth = F.col("part") * REPEATS + F.col("nth")
    words = written(each.select("doc_id", "size", "source", F.col("h").alias("row"), F.when(nth == 0, F.col("h")).otherwise(F.xxhash64("h", nth)).alias("h")))
    goals = targets(words, weights, most)
    places = goals.select(F.col("source").alias("s"), "source_size", "target", F.xxhash64(F.coalesce("source", F.lit("\x00null"))).alias("place"))
    n = words.count()
    chunks = max(1, -(-n // CHUNK))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        words.join(F.broadcast(places), words["source"].eqNullSafe(places["s"]))  # one row a source, collected above
        .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("p", F.col("rate") - F.col("whole"))
        .withColumn("chunk", F.pmod("h", F.lit(chunks)))
        .select("doc_id", "size", "source", "source_size", "target", "place", "whole", "p", "h", "row", "chunk")
    )
    settled = rows.where(~((F.col("p") > 0) & (F.col("p") < 1)))
    open_rows = rows.where((F.col("p") > 0) & (F.col("p") < 1))
    while True:
        now = written(_level(open_rows, seed, last=chunks == 1))
        settled = settled.unionByName(now.where(~((F.col("p") > 0) & (F.col("p") < 1))))
        if chunks == 1:
            break
        open_rows = now.where((F.col("p") > 0) & (F.col("p") < 1))
        chunks = -(-chunks // FAN_IN)
        open_rows = open_rows.withColumn("chunk", F.pmod("chunk", F.lit(chunks)))
    copies = (F.col("whole") + F.col("p")).cast("long")
    return settled.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "source", "row")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as often as the mix takes them, with mix_copy (from 1), mix_size and mix_target added; others are left out.

    Columns of these three names that docs has already, those of an earlier mix, are replaced; all others stay as they are. A document
    without words is left out. Repeated rows are told apart by a number, so each is taken as often as its own draw says.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = [F.col(f"row.`{c}`") for c in (id_col, source_col)]
    size = F.coalesce(F.regexp_count(F.col(f"row.`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = rows.select("row", own[0].cast("long").alias("r_id"), own[1].cast("string").alias("r_source"), size.alias("r_size"), _row(own[0], F.col(f"row.`{text_col}`"), seed).alias("r_row"))
    taken = mix(docs, weights, most, seed, id_col, text_col, source_col)
    # Rows of one id, source and text are repeats: the numbers pair them off. Sorted, never held.
    nth = Window.partitionBy("r_id", "r_source", "r_size", "r_row").orderBy("r_row")
    drawn = Window.partitionBy("doc_id", "source", "size", "row").orderBy("copies")
    rows = rows.withColumn("nth", F.row_number().over(nth))
    taken = taken.withColumn("t_nth", F.row_number().over(drawn)).withColumnRenamed("row", "t_row")
    same = (rows["r_row"] == taken["t_row"]) & rows["r_id"].eqNullSafe(taken["doc_id"]) & rows["r_source"].eqNullSafe(taken["source"]) & (rows["r_size"] == taken["size"]) & (rows["nth"] == taken["t_nth"])
    both = rows.join(taken.where(F.col("copies") > 0), same)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("mix_copy", "mix_size", "mix_target")]  # an earlier mix's go
    return both.select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("mix_copy"), F.col("size").alias("mix_size"), F.col("target").alias("mix_target"))
