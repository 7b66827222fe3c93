"""Each query with SQL gives the SQL's rows; the others run."""

import re
from difflib import SequenceMatcher

import duckdb
import pytest

from folioloom.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def whole_run(spark):
    """The rows of knowledge_run, one after the other: leaders by name, then those whose meaning no earlier one has, single ones before merged ones."""
    from folioloom.operators.retrieval import hashed_ngrams

    leaders = {}
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        words = re.findall("[a-z]{4,}", (r.text or "").lower())
        if not words:
            continue
        a, b = words[0], words[-1]
        new = f"{a}_of"
        like = next((x for x in leaders if x in (new, new + "s") or new == x + "s" or SequenceMatcher(None, x, new).ratio() >= 0.85), None)
        if like:
            leaders[like][0] = True
        else:
            leaders[new] = [False, r.doc_id, f"A {a} belongs to a {b}. What a {b} has of {a}."]
    order = sorted((*about, name) for name, about in leaders.items())
    vectors = hashed_ngrams([text for _, _, text, _ in order])
    kept = []
    for i in range(len(order)):
        if all(vectors[k] @ vectors[i] < 0.80 for k in kept):
            kept.append(i)
    return leaders, sorted((order[i][1], order[i][3]) for i in kept)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = [tuple(r) for r in df.select(*columns).collect()]
    rows = sorted(repr(plain(r)) for r in found)
    if name in ORACLES:
        quoted = ", ".join(f'"{c}"' for c in columns)
        want = con.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
        assert sorted(con.sql(ORACLES[name]).columns) == columns
        assert rows == sorted(repr(plain(r)) for r in want)
    if name == "knowledge_run":
        leaders, want = whole_run(spark)
        at = columns.index("source_pdf"), columns.index("name")
        assert sorted(tuple(r[i] for i in at) for r in found) == want and 1 < len(want) < len(leaders) < 200


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_whole_run_reads_all_documents_with_the_default_options(spark, monkeypatch):
    from folioloom import catalogue
    from folioloom.plans.run import Options

    seen = {}

    def extract(snippets, classes, model, options, index=None, **more):
        seen.update(docs={r.source_pdf for r in snippets.select("source_pdf").distinct().collect()}, options=options, corpora={r.corpus for r in index.select("corpus").distinct().collect()})
        raise StopIteration

    monkeypatch.setattr(catalogue.knowledge, "extract", extract)
    with pytest.raises(StopIteration):
        catalogue.knowledge_run(spark, SF)
    texts = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where("trim(text) <> ''").collect()}
    assert seen == {"docs": texts, "options": Options(), "corpora": {"benchmark", "conversations"}}


def test_markup_moves_a_document_once(spark, capsys):
    QUERIES["word_markup"](spark, SF).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_lines_do_not_depend_on_how_the_words_are_planned(spark):
    """Words that come out of a join by the columns' keys, which may become a broadcast, give the lines of written ones."""
    from folioloom import catalogue
    from folioloom.operators import layout
    from folioloom.sources.store import written

    split = layout.split_columns(catalogue._words(spark, "/root/testdata/sf0.01"))
    lazy, eager = (layout.group_lines(w).drop("ws") for w in (split, written(split)))
    assert lazy.count() == eager.count() and lazy.exceptAll(eager).isEmpty()
