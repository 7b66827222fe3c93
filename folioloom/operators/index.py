"""A passage index that is refreshed file by file: rows (corpus, source_file, chunk_index, text, vector)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions.text import paragraphs_of, passage_sentences
from folioloom.operators.retrieval import Encoder, encode, hashed_ngrams
from folioloom.sources import store

#: Changes in how passages are cut need a new number.
CHUNKING = 2


def manifest(files: DataFrame) -> DataFrame:
    """corpus, source_file, sha256 of files (corpus, source_file, content)."""
    return files.select("corpus", "source_file", F.sha2("content", 256).alias("sha256"))


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """corpus, source_file, change: 'new', 'changed', 'removed' or 'same', by the files' hashes."""
    a = now.select("corpus", "source_file", F.col("sha256").alias("now"))
    b = before.select("corpus", "source_file", F.col("sha256").alias("before"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("before")), "same").otherwise("changed")
    return a.join(b, ["corpus", "source_file"], "full_outer").select("corpus", "source_file", change.alias("change"))


def _pdf_paragraphs(files: DataFrame) -> DataFrame:
    """corpus, source_file, parts: body paragraphs of PDFs, by their words' coordinates. None where no program tells them."""
    from folioloom.operators.blocks import LEAST, body_only
    from folioloom.operators.layout import blocks_from_words
    from folioloom.sources.documents import pdf_markup, words_of_markup

    named = files.select(F.to_json(F.struct("corpus", "source_file")).alias("path"), "content")
    found = body_only(blocks_from_words(words_of_markup(pdf_markup(named)))).where(F.length("text") >= LEAST)
    each = found.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]).alias("parts"))
    return each.select(F.from_json("doc", "corpus string, source_file string").alias("f"), "parts").select("f.*", "parts")


def chunks(files: DataFrame, by_sentence: bool = False) -> DataFrame:
    """corpus, source_file, chunk_index, text: passages of text files, without bytes that are no UTF-8; of PDFs, of their paragraphs."""
    is_pdf = F.lower("source_file").endswith(".pdf")
    binary = dict(files.dtypes)["content"] == "binary"
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")) if binary else F.col("content")
    rows = (files.where(~is_pdf) if binary else files).select("corpus", "source_file", paragraphs_of(text).alias("parts"))
    if binary and not (pdf := files.where(is_pdf)).isEmpty():
        rows = rows.unionByName(_pdf_paragraphs(pdf))
    parts = F.flatten(F.transform("parts", passage_sentences)) if by_sentence else F.col("parts")
    return rows.select("corpus", "source_file", F.posexplode(parts).alias("chunk_index", "text"))


def refresh(index: DataFrame, files: DataFrame, before: DataFrame, encoder: Encoder = hashed_ngrams, by_sentence: bool = False) -> tuple[DataFrame, DataFrame]:
    """The refreshed index, kept passages and those of changed files, and the new manifest. Only changed files are encoded."""
    now = manifest(files)
    change = diff(now, before)
    fresh = change.where(F.col("change").isin("new", "changed")).select("corpus", "source_file")
    stale = change.where(F.col("change") != "same").select("corpus", "source_file")
    kept = index.join(stale, ["corpus", "source_file"], "left_anti")
    made = encode(chunks(files.join(fresh, ["corpus", "source_file"], "left_semi"), by_sentence), "text", encoder)
    return kept.unionByName(made.select(*kept.columns)), now


PASSAGES = "source_file string, chunk_index int, text string, vector array<float>, version long, corpus string"
MANIFEST = "corpus string, source_file string, sha256 string, passages long, version long"


class Stored:
    """An index that is kept in a folder all executors share.

    passages/version=v/corpus=c has a corpus' passages, manifest/version=v what each file was (its hash, number of passages, and the version that its
    corpus' passages are in), current.json which version is the last. That file is written last, so a refresh that breaks off leaves the index as it was, and
    is made again. A refresh writes the corpora with changed files only, and encodes those files only.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, encoder: Encoder = hashed_ngrams, by_sentence: bool = True):
        self.spark, self.path, self.model, self.encoder, self.by_sentence = spark, path.rstrip("/"), model, encoder, by_sentence

    def _current(self) -> dict:
        fs, at = store._path(self.spark, f"{self.path}/current.json")
        if not fs.exists(at):
            return {"version": 0}
        return json.loads("\n".join(r.value for r in self.spark.read.text(store.literal(f"{self.path}/current.json")).collect()))

    def _manifest(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(store.literal(f"{self.path}/manifest/version={version}"))

    def _passages(self, told: DataFrame) -> DataFrame:
        """The passages of a manifest's versions."""
        versions = sorted(r["version"] for r in told.where("passages > 0").select("version").distinct().collect())
        if not versions:
            return self.spark.createDataFrame([], PASSAGES)
        base = store.literal(f"{self.path}/passages")
        every = self.spark.read.schema(PASSAGES).option("basePath", base).parquet(*[f"{base}/version={v}" for v in versions])
        return every.join(F.broadcast(told.select("corpus", "version").distinct()), ["corpus", "version"], "left_semi")  # a row a corpus

    def read(self) -> DataFrame:
        """corpus, source_file, chunk_index, text, vector."""
        return self._passages(self._manifest(self._current()["version"])).drop("version")

    def refresh(self, files: DataFrame) -> dict:
        """The index brought to what files (corpus, source_file, content) are; how many files were encoded, removed, kept, and rebuilt corpora.

        All is made anew if passages are cut in another way or another model made the vectors; so is a corpus whose passages are not as many as its manifest says, or
        lack vectors.
        """
        last = self._current()
        same = last.get("chunking") == CHUNKING and last.get("model") == self.model
        version = last["version"]
        before = self._manifest(version if same else 0)
        held = self._passages(before)
        found = held.groupBy("corpus").agg(F.count("vector").alias("n"))
        broken = before.groupBy("corpus").agg(F.sum("passages").alias("want")).join(found, "corpus", "left").where(F.coalesce("n", F.lit(0)) != F.col("want")).select("corpus")
        broken = [r["corpus"] for r in broken.collect()]  # corpora are few
        good = before.where(~F.col("corpus").isin(broken)) if broken else before
        now = store.written(manifest(files))
        change = store.written(diff(now, good))
        counts = {r["change"]: r["n"] for r in change.groupBy("change").agg(F.count("*").alias("n")).collect()}
        told = {"encoded": counts.get("new", 0) + counts.get("changed", 0), "removed": counts.get("removed", 0), "kept": counts.get("same", 0), "rebuilt": broken}
        if same and version and not told["encoded"] and not told["removed"] and not broken:
            return told
        touched = change.where("change <> 'same'").select("corpus").distinct()
        kept = held.drop("version").join(touched, "corpus", "left_semi").join(change.where("change = 'same'").select("corpus", "source_file"), ["corpus", "source_file"], "left_semi")
        fresh = change.where(F.col("change").isin("new", "changed")).select("corpus", "source_file")
        made = encode(chunks(files.join(fresh, ["corpus", "source_file"], "left_semi"), self.by_sentence), "text", self.encoder)
        columns = ["source_file", "chunk_index", "text", "vector", "corpus"]
        # Not beside what is read: a version that broke off is overwritten.
        at = f"{self.path}/passages/version={version + 1}"
        kept.select(columns).unionByName(made.select(columns)).write.mode("overwrite").partitionBy("corpus").parquet(at)
        new = self.spark.read.schema(PASSAGES.replace(", version long", "")).parquet(store.literal(at)).groupBy("corpus", "source_file").agg(F.count("*").alias("passages"))
        listed = now.join(touched, "corpus", "left_semi").join(new, ["corpus", "source_file"], "left").select("corpus", "source_file", "sha256", F.coalesce("passages", F.lit(0)).alias("passages"), F.lit(version + 1).cast("long").alias("version"))
        rest = good.join(touched, "corpus", "left_anti")
        rest.unionByName(listed).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version + 1}")
        store.write_json(self.spark, f"{self.path}/current.json", {"version": version + 1, "chunking": CHUNKING, "model": self.model})
        self._sweep(version + 1)
        return told

    def _sweep(self, version: int) -> None:
        """Versions that no manifest row names any more go, once the new one is the current one."""
        used = {r["version"] for r in self._manifest(version).select("version").distinct().collect()} | {version}
        for v in range(1, version):
            for kind, stays in (("passages", v in used), ("manifest", False)):
                if not stays:
                    fs, at = store._path(self.spark, f"{self.path}/{kind}/version={v}")
                    fs.delete(at, True)
