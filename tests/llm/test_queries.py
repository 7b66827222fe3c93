"""Queries against their SQL, the pipeline, and the guard for a missing subpackage."""

import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from folioloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def told(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    rows = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})").fetchall()
    assert told(df.select(*columns).collect()) == told(rows)


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {"pipeline", *QUERIES} <= entry.queries().keys()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and after.keys() <= before.keys()
        if name == "line_dedup":
            assert after.keys() == before.keys()
        else:
            assert all(before[d] == after[d] for d in after)
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} <= after.keys()
    assert [f for f, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]


def test_the_rest_works_without_this_subpackage(tmp_path):
    import os

    root = os.path.dirname(entry.__file__)
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q), q; assert 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, check=True)
