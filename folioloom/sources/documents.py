"""Documents and corpora: files of a folder as rows; PDF text by an external program where there is one."""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.text import expand_ligatures

WORDS = "doc string, page int, word_no long, x_min double, x_max double, y_min double, y_max double, text string"
_PAGE = re.compile(r"<page\b[^>]*>(.*?)</page>", re.S)
_WORD = re.compile(r"<word\b([^>]*)>(.*?)</word>", re.S)
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')
#: Words that leave a task at once.
AT_ONCE = 16_384


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the PDFs in a folder, not below it. An empty folder is an error."""
    out = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")
    if out.isEmpty():
        raise ValueError(f"no PDF in {folder}")
    return out


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """corpus, source_file, content: .pdf, .txt and .md files at any depth of a root's folders; no hidden ones, no index, no README at a corpus' top."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^/*" + re.escape(base.lstrip("/")) + "/", "")
    rows = raw.withColumn("_b", below).withColumn("corpus", F.split("_b", "/")[0]).withColumn("source_file", F.expr("substring(_b, length(corpus) + 2)"))
    good = F.lower("source_file").rlike(r"\.(pdf|txt|md)$") & ~F.col("corpus").startswith(".") & ~F.lower("source_file").rlike(r"^readme\.[^/]*$") & (F.col("corpus") != "index")
    return rows.where(good & F.col("_b").contains("/")).select("corpus", "source_file", "content")


def parse_words(xml: str, doc: str) -> Iterator[tuple]:
    """Words with coordinates from bounding-box markup; empty and malformed ones are skipped."""
    for page, body in enumerate(_PAGE.finditer(xml), 1):
        n = 0
        for attributes, text in (w.groups() for w in _WORD.finditer(body[1])):
            at = dict(_ATTRIBUTE.findall(attributes))
            try:
                box = [float(at[k]) for k in ("xMin", "xMax", "yMin", "yMax")]
            except (KeyError, ValueError):
                continue
            if text := unescape(text).strip():
                yield (doc, page, n, *box, text)
                n += 1


def words_of_markup(df: DataFrame, doc_col: str = "doc", xml_col: str = "xml") -> DataFrame:
    """Word rows of documents already converted to bounding-box markup.

    One document's markup is read at a time, and words leave as they are found: what a task holds does not grow with the documents of a batch, nor with a document's words.
    """
    names, kinds = zip(*(c.split() for c in WORDS.split(", ")))
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def told(rows: list[tuple]) -> pa.RecordBatch:
        # A number that is none is null, as it is in pandas.
        return pa.RecordBatch.from_arrays([pa.array(c, arrow[k], from_pandas=True) for c, k in zip(zip(*rows), kinds)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, x in zip(b.column(0), b.column(1)):
                for w in parse_words(x.as_py() or "", d.as_py()):
                    rows.append(w)
                    if len(rows) == AT_ONCE:
                        yield told(rows)
                        rows = []
            if rows:
                yield told(rows)

    return df.select(F.col(doc_col).cast("string").alias("doc"), F.col(xml_col).alias("xml")).mapInArrow(run, WORDS).withColumn("text", expand_ligatures(F.col("text")))


def pdf_markup(files: DataFrame, arguments: tuple[str, ...] = ("-bbox-layout",)) -> DataFrame:
    """doc, xml: what an external program makes of each PDF; null where it is absent or fails. The file goes through a pipe, not a disk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = shutil.which("pdftotext")
        for b in batches:
            out = []
            for content in b["content"]:
                done = subprocess.run([program, *arguments, "-", "-"], input=content, capture_output=True) if program else None
                out.append(done.stdout.decode("utf-8", "ignore") if done is not None and not done.returncode else None)
            yield pd.DataFrame({"doc": b["path"], "xml": out})

    return files.select("path", "content").mapInPandas(run, "doc string, xml string")


def text_pages(df: DataFrame, doc_col: str = "doc", text_col: str = "text") -> DataFrame:
    """doc, page, text: text cut at form feeds, pages counted from 1; a last empty piece is no page."""
    pieces = df.select(F.col(doc_col).alias("doc"), F.posexplode(F.split(F.regexp_replace(text_col, r"\f$", ""), r"\f")).alias("n", "text"))
    return pieces.select("doc", (F.col("n") + 1).alias("page"), "text")
