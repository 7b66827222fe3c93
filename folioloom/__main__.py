"""Command line: the stages of a run over folders of documents; each stage reads and writes tables in the run's folder."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.text import is_furniture
from folioloom.operators import blocks, checkpoint, resolve, validate
from folioloom.operators.index import Stored
from folioloom.operators.layout import blocks_from_words
from folioloom.operators.retrieval import Encoder, hashed_ngrams
from folioloom.plans import judges, knowledge
from folioloom.plans.model import Counters, HttpModel, Model, Stub
from folioloom.plans.prompts import CATALOGUE, OURS, Category, Templates, all_sections, categories_of, parse_categories
from folioloom.plans.run import Options, command_line, elapsed, options_of, run_stages, unknown
from folioloom.sources import documents, store
from folioloom.streaming.snippets import extract_stream, stream_snippets


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store.literal(path))
    except Exception as none:
        if "PATH_NOT_FOUND" not in str(none):
            raise
        return None


SNIPPETS = "source_pdf string, paragraph_index int, page int, text string"
#: Snippets of a file of them, which is a batch: what is lost at most when a run breaks off.
BATCH = 64


def _snippets(spark: SparkSession, folder: str, options: Options) -> DataFrame:
    """Snippets of a folder's PDFs, by their words' coordinates where a program tells them, and of its text files."""
    raw = spark.read.format("binaryFile").load(store.literal(folder)).select(F.element_at(F.split("path", "/"), -1).alias("doc"), "content")
    text = raw.where(F.lower("doc").endswith(".txt")).select("doc", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    found = blocks.body_only(blocks.blocks_from_text(documents.text_pages(text), is_furniture))
    pdf = raw.where(F.lower("doc").endswith(".pdf")).select(F.col("doc").alias("path"), "content")
    geometry = found.limit(0)
    if not pdf.isEmpty():
        geometry = store.written(blocks.body_only(blocks_from_words(documents.words_of_markup(documents.pdf_markup(pdf)), is_furniture(F.col("text")))))
    found = blocks.paragraphs(geometry, found)
    return blocks.snippets(found, options.unit == "sentence").withColumnRenamed("doc", "source_pdf")


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = store._path(spark, path)
    return fs.exists(at)


def _forget(spark: SparkSession, path: str) -> None:
    fs, at = store._path(spark, path)
    fs.delete(at, True)


class Run:
    """A run's folder, its tables, and the stages that fill them. Each stage is true once its table is there."""

    def __init__(self, spark: SparkSession, options: Options, papers: str, out: str, corpora: str | None, classes: list[Category], model: Callable[[], Model], encoder: Encoder = hashed_ngrams, templates: Templates = OURS):
        self.spark, self.options, self.papers, self.corpora, self.classes, self.model, self.encoder, self.templates = spark, options, papers, corpora, classes, model, encoder, templates
        self.out = out.rstrip("/")
        self.at = f"{self.out}/{options.folder()}"
        self.summary: dict[str, int] = {}

    def rows(self, name: str) -> DataFrame | None:
        """A table that is there and has rows."""
        found = _read(self.spark, f"{self.at}/{name}")
        return None if found is None or found.isEmpty() else found

    def raw(self) -> DataFrame | None:
        """Extracted rows of finished snippets."""
        rows, log = _read(self.spark, f"{self.at}/raw"), _read(self.spark, f"{self.at}/log")
        return None if rows is None or log is None else checkpoint.keep_finished(rows, log.select(*checkpoint.KEY).distinct())

    def extract(self) -> bool:
        """Batches of snippets, answered and logged one after the other. A run that broke off goes on behind its last whole batch; a finished one is used as it is."""
        signature = self.options.content_hash(*(repr(c) for c in self.classes), repr(self.templates))
        begun = _exists(self.spark, f"{self.at}/signature.json") and json.loads("".join(r.value for r in self.spark.read.text(store.literal(f"{self.at}/signature.json")).collect()))
        if self.options.restart or begun != signature:
            for part in ("raw", "log", "snippets", "stream", "counts", "finished.json", "signature.json"):
                _forget(self.spark, f"{self.at}/{part}")
        if _exists(self.spark, f"{self.at}/finished.json"):
            return True
        if not _exists(self.spark, f"{self.at}/signature.json"):
            found = store.numbered(_snippets(self.spark, self.papers, self.options), "source_pdf", "paragraph_index", name="n")
            found = store.written(found)
            if found.isEmpty():
                print(f"nothing to read in {self.papers}", file=sys.stderr)
                return False
            parts = -(-found.count() // BATCH)
            found.repartitionByRange(parts, "n").drop("n").write.mode("overwrite").parquet(f"{self.at}/snippets")
            store.write_json(self.spark, f"{self.at}/signature.json", signature)  # only now is there something to go on with
        known = None
        if self.options.use_rag and self.corpora:
            index = Stored(self.spark, f"{self.out}/index", f"{self.encoder.__module__}.{self.encoder.__qualname__}", self.encoder)
            self.summary |= {f"index files {k}": v for k, v in index.refresh(documents.corpus_files(self.spark, self.corpora)).items() if k != "rebuilt"}
            known = index.read()
        classes = self.spark.createDataFrame([(i, c.name, c.definition, c.narrative) for i, c in enumerate(self.classes)], "n int, name string, definition string, narrative string")
        counters = Counters()

        def work(batch: DataFrame) -> DataFrame:
            nonlocal counters
            counters = Counters()
            return knowledge.extract(batch, classes, self.model, self.options, known, None, self.encoder, counters, self.templates)

        def after(number: int) -> None:
            store.write_json(self.spark, f"{self.at}/counts/batch={number}.json", counters.totals())

        stream = extract_stream(stream_snippets(self.spark, f"{self.at}/snippets", SNIPPETS, 1), work, f"{self.at}/raw", f"{self.at}/log", f"{self.at}/stream", after)
        stream.awaitTermination()
        store.write_json(self.spark, f"{self.at}/finished.json", {"finished": True})
        return True

    def merge(self) -> bool:
        raw = self.raw()
        good = None if raw is None else raw.where(F.col("reject_reason").isNull())
        if good is None or good.isEmpty():
            return False
        # The order of arrival decides who leads.
        good = store.numbered(good.select(*validate.REQUIRED, "source_pdf", "paragraph_index", "class_no", "place"), "source_pdf", "paragraph_index", "class_no", "place")
        judge = judges.merge_judge(self.model, True, not self.options.use_classes, templates=self.templates)
        self._write(resolve.merge_by_name(good.select("seq", *validate.REQUIRED, "source_pdf"), True, judge), "merged", "merged by name")
        return True

    def cluster(self) -> bool:
        if (merged := self.rows("merged")) is None:
            return False
        store.write_clusters(knowledge.cluster(merged, self.options.threshold, self.encoder), f"{self.at}/clusters")
        return True

    def disambiguate(self) -> bool:
        if self.rows("clusters") is None:
            return False
        several = store.read_clusters(self.spark, store.literal(f"{self.at}/clusters"))
        many = resolve.reduce_steps(several, judges.same_judge(self.model, not self.options.use_classes, templates=self.templates), f"{self.at}/state", self.options.threshold)
        both = many.unionByName(store.read_isolated(self.spark, store.literal(f"{self.at}/clusters"))).drop("vector", "size")
        both.write.mode("overwrite").parquet(f"{self.at}/reduced")
        return True

    def merge_global(self) -> bool:
        if (reduced := self.rows("reduced")) is None:
            return False
        self._write(resolve.merge_by_name(reduced, False, judges.merge_judge(self.model, False, not self.options.use_classes, templates=self.templates)), "relations", "merged over all")
        return True

    def _write(self, merged: DataFrame, name: str, what: str) -> None:
        """A merged table; how many rows it has and how many others were folded into them are counted as they pass."""
        seen = Counters()
        seen.watch(merged, **{what: F.count(F.lit(1)), f"{what}, folded": F.sum(F.col("n_folded") - 1)}).drop("n_folded").write.mode("overwrite").parquet(f"{self.at}/{name}")
        self.summary |= seen.totals()

    def snapshot(self) -> None:
        """All tables of the run beside the options, under its name."""
        tables = {n: df for n in ("merged", "reduced", "relations", "clusters") if (df := _read(self.spark, f"{self.at}/{n}")) is not None}
        if (raw := self.raw()) is not None:
            tables["raw"] = raw
        if tables:
            store.snapshot(tables, f"{self.out}/snapshots", self.options.signature(), time.time(), asdict(self.options))

    def counts(self) -> dict[str, int]:
        """What the run has counted: of its extraction, batch by batch, whenever it ran, and of the stages of this call."""
        out: dict[str, int] = {}
        if _exists(self.spark, f"{self.at}/counts"):
            each = self.spark.read.option("multiLine", True).schema("requests long, truncated long, failed long, unreadable long, lenient long, relations long, rejected long").json(store.literal(f"{self.at}/counts"))
            out = {k: v or 0 for k, v in each.agg(*[F.sum(c).alias(c) for c in each.columns]).head().asDict().items()}
        return out | self.summary

    def stages(self) -> dict[str, Callable[[], bool]]:
        return {"extract": self.extract, "merge": self.merge, "cluster": self.cluster, "disambiguate": self.disambiguate, "merge_global": self.merge_global}


def main(argv: list[str] | None = None, model: Callable[[], Model] | None = None) -> int:
    """0 if all stages were completed, 1 if one was not, 2 for a stage that there is not."""
    told = command_line().parse_args(argv)
    if bad := unknown(told.stages):
        print(f"unknown stages: {', '.join(bad)}", file=sys.stderr)
        return 2
    options = options_of(told)
    spark = SparkSession.builder.appName("folioloom").getOrCreate()
    name, url = options.model, told.url
    model = model or ((lambda: HttpModel(url, name)) if url else (lambda: Stub(lambda prompt: '{"relations": []}')))
    classes = [Category(c, "", "", "") for c in validate.CLASSES]
    whole = lambda path: spark.read.text(store.literal(path), wholetext=True).head().value
    sections = all_sections(map(whole, told.prompts))
    if told.classes:
        classes = categories_of(whole(told.classes))
    elif CATALOGUE in sections:
        classes = parse_categories(sections[CATALOGUE])
    began = time.time()
    run = Run(spark, options, told.papers, told.out, told.corpora, classes, model, templates=Templates.of(sections))
    done = run_stages(list(options.stages), run.stages(), run.snapshot)
    for what, n in {**run.counts(), "elapsed": elapsed(time.time() - began)}.items():
        print(f"{what}: {n}")
    return 0 if done else 1


if __name__ == "__main__":
    sys.exit(main())
