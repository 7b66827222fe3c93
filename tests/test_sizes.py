"""What must not depend on the size of the input, or be done by one task."""

import numpy as np
import pytest

from folioloom import catalogue_parts, catalogue_runs
from folioloom.llm import simhash
from folioloom.operators import retrieval

SF = "/root/testdata/sf0.01"


def test_encoded_doubles_are_rounded_once(spark):
    text = "".join(c * n for c, n in zip("aeinr", (32, 54, 1, 25, 9)))
    df = spark.createDataFrame([(text,)], "text string")
    once, twice = (retrieval.encode(df, "text", catalogue_parts.letters, **more).head()["vector"] for more in ({"kind": "double"}, {}))
    x = np.array([32, 54, 1, 25, 9]) / np.linalg.norm([32, 54, 1, 25, 9])
    assert once == x.tolist() and round(once[1], 4) == 0.7921
    assert round(twice[1], 4) == 0.7922  # a float's


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_streamed_snippets_are_written_by_many_tasks(small_splits, monkeypatch, tmp_path):
    docs = str(tmp_path)
    small_splits.read.parquet(f"{SF}/documents.parquet").repartition(8).write.parquet(f"{docs}/documents.parquet")
    at = []
    fresh = catalogue_parts._fresh
    monkeypatch.setattr(catalogue_parts, "_fresh", lambda s: at.append(fresh(s)) or at[-1])
    assert catalogue_runs.streamed_snippets(small_splits, docs).count() == 1000
    held = [r["count"] for r in small_splits.read.parquet(f"{at[0]}/in").selectExpr("input_file_name() AS f").groupBy("f").count().collect()]
    assert sum(held) == 3000 and max(held) < 400


def test_corpus_files_are_written_by_many_tasks(small_splits, monkeypatch, tmp_path):
    docs = str(tmp_path)
    small_splits.read.parquet(f"{SF}/documents.parquet").repartition(8).write.parquet(f"{docs}/documents.parquet")
    at = []
    fresh = catalogue_parts._fresh
    monkeypatch.setattr(catalogue_parts, "_fresh", lambda s: at.append(fresh(s)) or at[-1])
    assert catalogue_parts.corpus_files(small_splits, docs).count() == catalogue_parts.corpus_files(small_splits, SF).count()
    files = {r.f.split("/")[-1].split("-")[1] for r in small_splits.read.text(at[0]).selectExpr("input_file_name() AS f").distinct().collect()}
    assert len(files) == 8


def test_few_copies_of_passages(spark, monkeypatch):
    """Ten times the queries are not ten times the copies of a passage."""
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    df = spark.createDataFrame([(i, "c", [float(i % 7), 1.0]) for i in range(1500)], "id long, corpus string, vector array<float>")
    plan = retrieval.top_passages(df, df, 2)._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 7" in plan and "sequence(0, 29" not in plan


def test_no_choice_of_frequent_shingles_loses_a_pair():
    """The sample orders shingles only: with any counts, of any shingles, similar sets share one of their prefixes."""
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        both = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        more = np.unique(rng.integers(0, 1 << 62, 2 * max(1, len(both) // 8)).astype(np.uint64))
        x, y = np.union1d(both, more[::2]), np.union1d(both, more[1::2])
        if len(np.intersect1d(x, y)) < 0.8 * len(np.union1d(x, y)):
            continue
        seen = np.sort(rng.choice(np.union1d(x, y), len(np.union1d(x, y)) // 2, replace=False))
        frequent = (seen, rng.integers(1, 1000, len(seen)))
        assert len(np.intersect1d(simhash.prefix(x, 0.8, frequent), simhash.prefix(y, 0.8, frequent)))


def test_lines_and_paragraphs_are_dealt_once_and_never_joined(spark):
    from folioloom import catalogue
    from folioloom.operators import layout

    lines = layout.group_lines(catalogue._words(spark, SF), ["doc", "page"], with_words=False)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (lines, layout.group_paragraphs(lines, ["doc", "page"]))]
    assert [p.count("Exchange") for p in plans] == [1, 2] and "Join" not in plans[1]


def test_words_of_markup_leave_before_all_documents_of_a_batch_are_read():
    """A task's memory: words of many documents, and of one long one, come in parts of a fixed size."""
    import pyarrow as pa

    from folioloom.sources import documents

    word = '<word xMin="1" xMax="2" yMin="nan" yMax="4">w</word>'
    xml = ["<page>" + word * 3_000 + "</page>"] * 40 + ["<page>" + word * 50_000 + "</page>", None]

    class Frame:
        """What stands for a table: the function that is run on its batches is kept."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def withColumn(self, *_):
            return self

    from unittest import mock

    with mock.patch.object(documents, "F"), mock.patch.object(documents, "expand_ligatures"):
        run = documents.words_of_markup(Frame()).run
    out = list(run(iter([pa.RecordBatch.from_pydict({"doc": [str(i) for i in range(42)], "xml": xml})])))
    assert max(b.num_rows for b in out) <= documents.AT_ONCE and sum(b.num_rows for b in out) == 40 * 3_000 + 50_000
    assert out[0].column(5).null_count == out[0].num_rows  # yMin: not a number


def test_columns_are_split_without_joins_as_the_cuts_say(spark):
    """Words move once and are joined to nothing; columns are those of the cuts, also without coordinates, width, order or keys."""
    import random

    from pyspark.sql import functions as F

    from folioloom.operators import layout

    rng, rows = random.Random(3), []
    for page in range(60):
        for n in range(rng.choice([0, 1, 39, 40, 41, 120, 400])):
            x = rng.choice([0, 0, 600, 1500, 2100]) + rng.choice([0.0, 0.25, 7.5]) * rng.randrange(40)
            x1 = None if rng.random() < 0.01 else x + rng.choice([0.0, 50.0, 50.0, 120.0, -3.0 if page % 7 == 0 else 20.0])
            rows.append((None if page % 11 == 5 else page % 4, page, n, None if rng.random() < 0.01 and page % 3 == 0 else x, x1, 1.0, 2.0, f"w{n}"))
    words = spark.createDataFrame(rows, "doc long, page int, word_no long, x_min double, x_max double, y_min double, y_max double, text string")
    want = words.withColumn("column", F.lit(""))
    for _ in range(2):
        joined = want.join(layout.column_cuts(want, ["doc", "page", "column"]), ["doc", "page", "column"], "left")
        left = F.col("cut") - F.col("x_min") >= F.col("x_max") - F.col("cut")
        want = joined.withColumn("column", F.concat("column", F.when(F.col("cut").isNull(), "").when(left, "L").otherwise("R"))).drop("cut").localCheckpoint()
    got = layout.split_columns(words)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r.column for r in want.collect()} >= {"", "L", "R", "LL", "LR"}
    plan = layout.split_columns(words)._jdf.queryExecution().executedPlan().toString()  # of one that has not run: a final plan is told beside the first
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_blocks_of_words_leave_no_words_behind(spark):
    """Words are written twice at most at a time; once blocks are made, only the body's lines are left."""
    from unittest import mock

    from folioloom import catalogue
    from folioloom.operators import layout
    from folioloom.sources import store

    left, most = set(), []

    def written(df):
        out = store.written(df)
        left.add(out._written)
        most.append(len(left))
        return out

    def forget(*tables):
        left.difference_update(t._written for t in tables)
        return real(*tables)

    real = store.forget
    with mock.patch.object(layout, "written", written), mock.patch.object(store, "forget", forget):
        assert layout.blocks_from_words(catalogue._words(spark, "/root/testdata/sf0.001", dealt=True)).count()
    assert max(most) == 2 and len(left) == 1


def test_a_query_is_encoded_once(spark):
    """The condition that a vector is there is not put below the encoder, and rows without one take no part."""
    from pyspark.sql import functions as F

    from folioloom.operators import retrieval
    from folioloom.sources.store import written

    texts = spark.createDataFrame([(str(i), "c", f"f{i}", f"text of {i} things") for i in range(50)], "id string, corpus string, source_file string, text string")
    passages = written(retrieval.encode(texts, "text"))
    best = retrieval.top_passages(passages, retrieval.encode(texts.select("id", "text"), "text"), k=2)
    assert best._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.query for r in best.where("rank = 1 AND query = id").collect()} == {str(i) for i in range(50)}
    some = lambda of: F.when(F.col("id").cast("int") % 3 != of, F.col("vector")).alias("vector")
    left = retrieval.top_passages(passages.select("id", "corpus", some(0)), passages.select("id", some(1)), k=50, least=-1.0)
    found = {(int(r.query), int(r.id)) for r in left.collect()}
    assert found == {(a, b) for a in range(50) if a % 3 != 1 for b in range(50) if b % 3 != 0}


def test_ngrams_are_counted_as_one_by_one():
    import numpy as np
    import xxhash

    from folioloom.operators.retrieval import hashed_ngrams

    texts = ["", "a", "Abra cadabra", "ﬁn — Ünï" * 40, " \n ", "x" * 5000]
    want = np.zeros((len(texts), 256), np.float32)
    for i, t in enumerate(texts):
        t = f" {t.lower()} "
        for j in range(max(1, len(t) - 2)):
            h = xxhash.xxh64_intdigest(t[j : j + 3])
            want[i, h % 256] += 1 if h >> 32 & 1 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert (hashed_ngrams(texts) == want).all()
