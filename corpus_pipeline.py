"""A corpus made ready for training: five stages over ``documents``, each over all that the one before it kept.

Every stage but the last returns the columns of documents; each result is written and read again before the next stage. What all stages
hold to, tested with such rows: any column may be null; a null text has no words, like an empty one; rows are told apart by what they
hold, not by doc_id, which may be null or shared; extra columns, whatever their names, go with their rows; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import decontaminate, lines, mixing, simhash, toxicity
from folioloom.llm._common import forget, table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays under toxicity.REJECT.

    Each row is judged by its own whole text, so repeated rows stay or go together. Null and empty texts are clean. Without labels
    that tell two grades the model rejects nothing.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 40 or more characters that five documents share, but in the largest doc_id.

    A null text stays null. n_chars, where there is one, follows a text that lost lines. A null doc_id is a document like others, but never
    the largest unless no other holds the line; repeated rows of one id are one document, and each loses the same lines.
    """
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept_text")).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near copies (five-word shingles, similarity 0.8 or more).

    Groups are of texts: texts that are unlike each other stay, also where they share an id or have none. A group without any id keeps
    one of its rows; texts without words are one group. Of equal rows one stays.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of five or more words. Each row is judged by its own text; null and empty texts are clean."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target has them, with mix_copy, mix_size and mix_target.

    Documents without words are in no mix. A null source is one of its own, the last. Repeated rows are documents of their own.
    """
    return mixing.apply_mix(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
]

#: A fitted classifier and random rounding are no SQL; tests hold each stage, on its own input, against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            forget(before)  # the documents themselves are no written table
    return docs
