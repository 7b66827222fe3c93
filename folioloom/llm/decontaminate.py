"""Benchmark decontamination: short test items inside long documents. DataFrame functions only.

The items are partitioned by size (their number of distinct shingles, q). An item that a document holds to a share t has
at most floor((1 - t) q) shingles missing, so of its floor((1 - t) q) + 1 shingles of least hash, its bottom MinHash sketch,
one at least is in the document. Each size has its own sketch length, and documents with fewer than t q shingles are
not searched for it. The sketches are the index; documents' shingles are looked up in it, and (document, item)
candidates are verified by counting the item's shingles, as texts, in the document. No contained item is missed. Items shorter than a
shingle are a size partition of their own: each is one shingle, its whole word sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm._common import written

SHINGLE, SHARE = 5, 0.8
#: An index or item table with no more rows than this is broadcast (24 and about 100 bytes a row); a larger one is shuffled.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Runs of letters, marks and digits in lower case, so that case and punctuation do not hide a copy."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, k: int, of: Callable[[list[Column]], Column], kind: str) -> Column:
    """What ``of`` makes of each k consecutive words."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of([F.get(words, i + j) for j in range(k)]).cast(kind))


def _texts(words: Column, sizes: list[int]) -> Column:
    return F.concat(*[_runs(words, k, lambda w: F.concat_ws(" ", *w), "string") for k in sizes])


def _hashes(words: Column, sizes: list[int]) -> Column:
    return F.concat(*[_runs(words, k, lambda w: F.xxhash64(*w), "long") for k in sizes])


def item_classes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item_class: items of the same words are one class, named by its least id. Null text has no words."""
    w = items.select(F.col(id_col).alias("item_id"), F.array_join(words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), " ").alias("w"))
    return w.join(w.groupBy("w").agg(F.min("item_id").alias("item_class")), "w").select("item_id", "item_class")


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _found(docs: DataFrame, items: DataFrame, k: int, share: float, id_col: str, text_col: str, item_col: str, item_text_col: str, least_words: int = 1) -> DataFrame:
    """doc_id, row_key (a hash of the text), item_id, n (shingles held), n_items, q."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    d = d.where(F.col("text").isNotNull())
    texts = items.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col).cast("string")).alias("w")).where(F.size("w") >= least_words)
    classes = texts.groupBy("w").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    # An item of fewer than k words is one shingle, the whole of it. Documents have shingles of each size that some item has.
    classes = written(classes.withColumn("k", F.least(F.size("w"), F.lit(k))))
    sizes = sorted(r["k"] for r in classes.select("k").distinct().collect())  # k numbers at most
    if not sizes:
        sizes = [k]
    parts = F.coalesce(*[F.when(F.col("k") == m, _texts(F.col("w"), [m])) for m in sizes])
    shingled = classes.select("item_id", "n_items", "k", F.array_distinct(parts).alias("s"))
    shingled = written(shingled.withColumn("q", F.size("s")))
    # share * q is compared with whole numbers: a hair less keeps 0.8 * 5 at 4.
    need = F.ceil(F.lit(share) * F.col("q") - 1e-9)
    length = F.col("q") - need + 1
    # A shingle is hashed as in documents, word by word.
    hashed = F.transform("s", lambda t: F.get(_hashes(F.split(t, " "), sizes) if len(sizes) == 1 else F.coalesce(*[F.when(F.size(F.split(t, " ")) == m, _hashes(F.split(t, " "), [m])) for m in sizes]), F.lit(0)))
    sketch = shingled.select("item_id", need.alias("need"), F.explode(F.slice(F.array_sort(hashed), F.lit(1), length.cast("int"))).alias("h"))
    sketch = written(sketch.distinct())

    most = sum(F.greatest(F.size("w") - m + 1, F.lit(0)) for m in sizes)
    hashed = d.select("doc_id", "row_key", words_of(F.col("text")).alias("w")).select("doc_id", "row_key", most.alias("n"), F.explode(_hashes(F.col("w"), sizes)).alias("h"))
    found = hashed.join(_checked(sketch), "h").where(F.col("n") >= F.col("need"))
    candidates = written(found.groupBy("doc_id", "row_key", "item_id").agg(F.count("*").alias("hits")).drop("hits"))

    some = candidates.select(F.col("doc_id").alias("c_doc"), F.col("row_key").alias("c_row")).distinct()
    held = d.join(some, d["doc_id"].eqNullSafe(some["c_doc"]) & (d["row_key"] == some["c_row"]), "left_semi")
    # The words are a column of their own: inside a lambda they would be split again for each shingle.
    there = held.select("doc_id", "row_key", words_of(F.col("text")).alias("w")).select("doc_id", "row_key", F.explode(F.array_distinct(_texts(F.col("w"), sizes))).alias("s"))
    wanted = _checked(written(shingled.select("item_id", F.explode("s").alias("s"))))
    c = candidates.select(F.col("doc_id").alias("c_doc"), F.col("row_key").alias("c_row"), F.col("item_id").alias("c_item"))
    hits = there.join(wanted, "s")
    hits = hits.join(c, hits["doc_id"].eqNullSafe(c["c_doc"]) & (hits["row_key"] == c["c_row"]) & (hits["item_id"] == c["c_item"]), "left_semi")
    # A row and its exact repeats have one key: distinct shingles are counted once.
    counted = hits.groupBy("doc_id", "row_key", "item_id", "s").agg(F.count("*")).groupBy("doc_id", "row_key", "item_id").agg(F.count("*").alias("n"))
    return counted.join(_checked(shingled.select("item_id", "n_items", "q")), "item_id").where(F.col("n") >= need)


def contaminated(
    docs: DataFrame, items: DataFrame, k: int = SHINGLE, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id, n_items, n_shingles, containment: each document that holds ``share`` or more of an item's shingles.

    item_id is the least id of the items with the same words, n_items how many they are. An item of fewer than k words is searched as
    one shingle, its whole word sequence; one without words, or null, is found nowhere, as is anything in a null text. Rows of one doc_id
    (or of none) count by the row that holds most; repeated rows count once. A very long text is searched whole, an empty table on either side gives no
    rows, and other columns are left out, whatever their names.
    """
    out = _found(docs, items, k, share, id_col, text_col, item_col, item_text_col)
    out = out.groupBy("doc_id", "item_id").agg(F.max("n").alias("n"), F.max("n_items").alias("n_items"), F.max("q").cast("long").alias("n_shingles"))
    return out.select("doc_id", "item_id", "n_items", "n_shingles", (F.col("n") / F.col("n_shingles")).alias("containment"))


def keep_clean(
    docs: DataFrame, items: DataFrame, k: int = SHINGLE, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = SHINGLE
) -> DataFrame:
    """docs without those that hold an item of ``least_words`` or more; all columns as they are, whatever their names.

    Shorter items are in many texts by chance, and documents with them are clean. Each row is judged by its own text: rows that share an id, or
    have none, are apart; repeated rows go or stay together. Null and empty texts are clean.
    """
    bad = _found(docs, items, k, share, id_col, text_col, item_col, item_text_col, least_words).select(F.col("doc_id").alias("b_id"), F.col("row_key").alias("b_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("r_key", F.xxhash64(F.col(f"row.`{text_col}`").cast("string")))
    same = rows["r_key"].eqNullSafe(bad["b_key"]) & F.col(f"row.`{id_col}`").eqNullSafe(bad["b_id"])
    return rows.join(bad, same, "left_anti").select("row.*")
