"""Connected components of a link table that no machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm._common import forget, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over links a > b. Large: all higher neighbours of a node move to its least one; small: the lower ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["u"])
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each node that has a link, and the least node it can reach.

    Alternating large and small stars (Kiveris et al., 2014): the number of rounds grows with the logarithm
    of the component's size; links never outnumber those given. A hub's rows meet in a join whose
    oversized partitions Spark splits; its least neighbour is aggregated before the shuffle.
    Self links and repeated links do no harm; null ends are no links.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b")))
    edges = written(edges.distinct())
    seen = None
    while True:
        before, edges = edges, written(_stars(_stars(edges, True), False))
        forget(before)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
