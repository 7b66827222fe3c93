"""Queries of single operators, with inputs made of the tables by rules that SQL can follow."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from folioloom.catalogue import CLASS_ROWS, COMPONENTS, LINES, NAME_KEY, V, WORDS, _classes, _lines, _relations, _vectors, _words, components, query, table
from folioloom.functions import headings
from folioloom.functions import text as tx
from folioloom.functions.similarity import predicate_matches, same_entity, similar_names
from folioloom.operators import blocks as bl
from folioloom.operators import checkpoint, index, layout, notes, resolve, retrieval, validate
from folioloom.plans import answers, judges, model, prompts
from folioloom.plans.run import Options
from folioloom.sources import documents, store

# --- sources and sinks -----------------------------------------------------------------------


def _fresh(spark) -> str:
    """A new folder of the shared one; what is written there goes when the driver ends."""
    path = f"{store.shared_dir(spark)}/folioloom-{uuid.uuid4().hex}"
    store._scratch.append((spark, path))
    return path


@query("corpus_files", f"WITH {LINES} SELECT 'source=' || source AS corpus, line FROM lines JOIN documents USING (doc_id) WHERE line <> ''")
def corpus_files(spark, sf_dir):
    at = _fresh(spark)
    # Written where the documents are read, in files of so many lines: a file is one row below.
    _lines(spark, sf_dir).select("source", "line").write.option("maxRecordsPerFile", 50_000).partitionBy("source").text(at)
    found = documents.corpus_files(spark, at)
    return found.select("corpus", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")


@query("word_markup", f"WITH {WORDS} SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY word_no) - 1 AS word_no, x_min, x_max, y_min, text FROM words")
def word_markup(spark, sf_dir):
    w = _words(spark, sf_dir, dealt=True)
    escaped = lambda t: F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    said = lambda x: F.format_string('<word xMin="%s" yMin="%s" xMax="%s" yMax="%s">%s</word>', x["x_min"], x["y_min"], x["x_max"], x["y_max"], escaped(x["text"]))
    # Words become markup behind the grouping: as such they are ten times as large.
    words = F.array_sort(F.collect_list(F.struct("word_no", "x_min", "x_max", "y_min", "y_max", "text")))
    pages = w.groupBy("doc", "page").agg(F.array_join(F.transform(words, said), "").alias("s"))
    xml = pages.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "s"))), lambda x: F.concat(F.lit("<page>"), x["s"], F.lit('<word xMin="1">broken</word></page>'))), "\n").alias("xml"))
    got = documents.words_of_markup(xml.select(F.col("doc").cast("string").alias("doc"), "xml"))
    return got.select(F.col("doc").cast("long").alias("doc"), "page", "word_no", "x_min", "x_max", "y_min", "text")


JSONL = "conv_id long, turn long, role string, text string"


@query("jsonl_append", "SELECT conv_id, turn, role, text, (SELECT count(*) FROM conversations) AS n_lines FROM conversations")
def jsonl_append(spark, sf_dir):
    c, at = table(spark, sf_dir, "conversations"), _fresh(spark)
    for part in (0, 1):
        store.append_jsonl(c.where(F.col("turn") % 2 == part), at)
    spark.createDataFrame([("",), ('{"conv_id": 1, "tu',), ("  ",)], "value string").coalesce(1).write.mode("append").text(at)
    return store.read_jsonl(spark, at, JSONL).withColumn("n_lines", F.lit(store.count_lines(spark, at) - 1).cast("long"))


@query("json_document", "SELECT lang, count(*) AS n, 'none' AS missing FROM documents GROUP BY lang")
def json_document(spark, sf_dir):
    at = _fresh(spark) + "/counts.json"
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    for rows in ([], [r.asDict() for r in counts.collect()]):  # a few languages; the second document takes the first one's place
        store.write_json(spark, at, rows)
    missing = store.read_json(spark, at + ".not", "lang string, n long", spark.createDataFrame([("none", 0)], "lang string, n long"))
    return store.read_json(spark, at, "lang string, n long").crossJoin(F.broadcast(missing.select(F.col("lang").alias("missing"))))  # one row


@query("cluster_store", f"{COMPONENTS}, n AS (SELECT *, (dense_rank() OVER (ORDER BY component) - 1)::INTEGER AS cluster_id, count(*) OVER (PARTITION BY component) AS size FROM c) SELECT node AS seq, cluster_id, size, size = 1 AS alone FROM n")
def cluster_store(spark, sf_dir):
    at = _fresh(spark)
    store.write_clusters(components(spark, sf_dir).select(F.col("node").alias("seq"), "cluster_id", "size"), at)
    several, alone = store.read_clusters(spark, at), store.read_isolated(spark, at)
    return several.withColumn("alone", F.lit(False)).unionByName(alone.withColumn("alone", F.lit(True)))


@query("snapshot_tables", "SELECT n_name, r_name, 'a__b' AS folder FROM nation JOIN region ON n_regionkey = r_regionkey")
def snapshot_tables(spark, sf_dir):
    root, tables = _fresh(spark), {t: table(spark, sf_dir, t) for t in ("nation", "region")}
    for _ in range(2):  # a second one of that name takes the first one's place
        at = store.snapshot(tables, root, "a/b", 1.0, {"model": "stub"})
    n, r = (spark.read.parquet(f"{at}/{t}") for t in ("nation", "region"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name", F.lit(at.rsplit("/", 1)[1]).alias("folder"))


@query("folder_names", r"SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'unknown_run' ELSE replace(replace(url, '/', '__'), chr(92), '__') || '__x' END AS folder FROM pages")
def folder_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.folder_name(F.when(F.col("page_id") % 9 == 0, "\x07").otherwise(F.concat("url", F.lit("\\x\t")))).alias("folder"))


# --- layout ----------------------------------------------------------------------------------


def _cuts_sql(name: str, source: str, keys: str) -> str:
    """Fixed SQL: the best vertical cut of each group of words, by trying all of them."""
    on = " AND ".join(f"w.{k} = s.{k}" for k in keys.split(", "))
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""{name}s AS (SELECT {keys}, min(x_min) AS lo, max(x_max) AS hi, count(*) AS n FROM {source} GROUP BY {keys} HAVING count(*) >= 40 AND max(x_max) > min(x_min)),
 {name}x AS (SELECT {keys}, x_min, x_max, count(*) AS m FROM {source} GROUP BY {keys}, x_min, x_max),
 {name}t AS (SELECT {own}, n, k AS step, lo + (hi - lo) * (0.25::DOUBLE + 0.5::DOUBLE * k / 200) AS cut, x_min, x_max, m FROM {name}x w JOIN {name}s s ON {on}, range(201) r(k)),
 {name}c AS (SELECT {keys}, n, step, cut, coalesce(sum(m) FILTER (x_max <= cut), 0) AS l, coalesce(sum(m) FILTER (x_min >= cut AND NOT x_max <= cut), 0) AS r, coalesce(sum(m) FILTER (NOT x_max <= cut AND NOT x_min >= cut), 0) AS x FROM {name}t GROUP BY ALL),
 {name} AS (SELECT {keys}, arg_min(cut, x / n * 1000 + step) AS cut FROM {name}c WHERE least(l, r) >= 0.25 * n AND x / n < 0.015 GROUP BY {keys})"""


def _side(cut: str) -> str:
    return f"CASE WHEN {cut} IS NULL THEN '' WHEN {cut} - x_min >= x_max - {cut} THEN 'L' ELSE 'R' END"


@query("column_split", f"""WITH {WORDS}, {_cuts_sql("one", "words", "doc, page")}, w1 AS (SELECT words.*, {_side("cut")} AS col FROM words LEFT JOIN one USING (doc, page)),
 {_cuts_sql("two", "w1", "doc, page, col")} SELECT doc, page, word_no, w1.col || {_side("cut")} AS "column" FROM w1 LEFT JOIN two USING (doc, page, col)""")
def column_split(spark, sf_dir):
    return layout.split_columns(_words(spark, sf_dir)).select("doc", "page", "word_no", "column")


#: Fixed SQL: documents as pages of twenty papers, each with a header line that tells the page.
PAGES = LINES + """, pl AS (SELECT doc_id % 20 AS doc, doc_id AS page, n, line AS text FROM lines UNION ALL SELECT doc_id % 20, doc_id, 0, 'Report  ' || doc_id || ' of paper ' || chr((65 + doc_id % 2)::INTEGER) FROM documents),
 pages_ AS (SELECT doc, page, n, (20 * n)::DOUBLE AS y_min, (20 * n + 10)::DOUBLE AS y_max, text FROM pl)"""


def _paper_lines(spark, sf_dir):
    d = F.col("doc_id")
    own = _lines(spark, sf_dir).select((d % 20).alias("doc"), d.alias("page"), F.col("n").cast("long").alias("n"), F.col("line").alias("text"))
    header = F.concat(F.lit("Report  "), d.cast("string"), F.lit(" of paper "), F.char((65 + d % 2).cast("long")))
    heads = table(spark, sf_dir, "documents").select((d % 20).alias("doc"), d.alias("page"), F.lit(0).cast("long").alias("n"), header.alias("text"))
    return own.unionByName(heads).withColumn("y_min", (20 * F.col("n")).cast("double")).withColumn("y_max", F.col("y_min") + 10)


RUNNING = f"""WITH {PAGES}, b AS (SELECT doc, page, min(y_min) AS top, max(y_max) AS end_ FROM pages_ GROUP BY ALL), k AS (SELECT doc, count(*) AS pages FROM b GROUP BY doc),
 f AS (SELECT doc, page, lower(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS form, y_min <= top + 0.12::DOUBLE * (end_ - top) OR y_max >= end_ - 0.12::DOUBLE * (end_ - top) AS margin FROM pages_ JOIN b USING (doc, page)),
 r AS (SELECT doc, form, count(DISTINCT page) AS n FROM f WHERE margin GROUP BY ALL), running AS (SELECT doc, form FROM r JOIN k USING (doc) WHERE pages >= 3 AND n >= greatest(3, floor(pages / 2)))"""


@query("running_lines", RUNNING + " SELECT doc, form FROM running")
def running_lines(spark, sf_dir):
    return layout.running_lines(_paper_lines(spark, sf_dir))


@query("lines_without_running", RUNNING + " SELECT doc, page, count(*) AS n FROM f ANTI JOIN running USING (doc, form) GROUP BY ALL")
def lines_without_running(spark, sf_dir):
    lines = _paper_lines(spark, sf_dir)
    return layout.without_running_lines(lines, layout.running_lines(lines)).groupBy("doc", "page").agg(F.count("*").alias("n"))


@query("layout_references", f"WITH {LINES}, p AS (SELECT doc_id AS doc, n // 4 AS paragraph, n AS line_no, CASE WHEN n = 9 AND doc_id % 2 = 0 THEN ' 7. References' ELSE line END AS text FROM lines) SELECT doc, paragraph, line_no, text FROM p WHERE doc % 2 = 1 OR paragraph < 2 OR doc NOT IN (SELECT doc FROM p WHERE line_no = 9)")
def layout_references(spark, sf_dir):
    n, d = F.col("n"), F.col("doc_id")
    text = F.when((n == 9) & (d % 2 == 0), " 7. References").otherwise(F.col("line"))
    lines = _lines(spark, sf_dir).select(d.alias("doc"), F.lit(1).alias("page"), F.lit("").alias("column"), F.floor(n / 4).cast("long").alias("paragraph"), n.cast("long").alias("line_no"), text.alias("text"))
    return layout.until_references(lines).select("doc", "paragraph", "line_no", "text")


# --- text pages and blocks -------------------------------------------------------------------

#: Fixed SQL: documents as pages of twenty papers; a references heading alone, after a gutter, or first on a page.
REFERENCES = """rp AS (SELECT doc_id % 20 AS doc, (doc_id // 20)::INTEGER AS page, CASE doc_id % 20 WHEN 3 THEN text || chr(10) || '  REFERENCES: ' || chr(10) || 'x' WHEN 4 THEN text || chr(10) || 'left   Bibliography' || chr(10) || 'x' WHEN 5 THEN 'References' || chr(10) || text ELSE text END AS text, text AS own, doc_id FROM documents),
 rc AS (SELECT doc, page, CASE WHEN doc % 20 IN (3, 4, 5) THEN CASE WHEN page > least_page THEN NULL WHEN doc = 5 THEN '' WHEN doc = 3 THEN own || chr(10) ELSE own || chr(10) || 'left   ' END ELSE text END AS text, doc NOT IN (3, 4, 5) OR page < least_page AS whole FROM (SELECT *, min(page) OVER (PARTITION BY doc) AS least_page FROM rp))"""


def _reference_pages(spark, sf_dir):
    d, t = F.col("doc_id"), F.col("text")
    text = F.when(d % 20 == 3, F.concat(t, F.lit("\n  REFERENCES: \nx"))).when(d % 20 == 4, F.concat(t, F.lit("\nleft   Bibliography\nx"))).when(d % 20 == 5, F.concat(F.lit("References\n"), t)).otherwise(t)
    return table(spark, sf_dir, "documents").select((d % 20).alias("doc"), F.floor(d / 20).cast("int").alias("page"), text.alias("text"))


@query("references_cut", f"WITH {REFERENCES} SELECT doc, page, text FROM rc WHERE text IS NOT NULL AND text <> ''")
def references_cut(spark, sf_dir):
    return bl.cut_pages_at_references(_reference_pages(spark, sf_dir))


@query("references_position", f"WITH {REFERENCES} SELECT doc, page, CASE doc WHEN 3 THEN length(own) + 1 WHEN 4 THEN length(own) + 8 WHEN 5 THEN 0 END AS at FROM rp")
def references_position(spark, sf_dir):
    return _reference_pages(spark, sf_dir).select("doc", "page", headings.references_position(F.col("text")).cast("long").alias("at"))


@query("page_cleaning", f"WITH {LINES} SELECT doc_id AS doc, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT starts_with(lower(line), 'the ')), '') AS text FROM lines GROUP BY doc_id")
def page_cleaning(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return bl.clean_pages(pages, lambda line: tx.is_header_or_footer(F.lower(line), ["\x01"], ["the "]))


#: Fixed SQL: words that end in "en" are broken after a hyphen at the end of a line.
BROKEN = r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, 'en ', 'en-' || chr(10)), '-\n(\p{Ll})', '\1', 'g'), '\s*\n\s*', ' ', 'g'), '^\s+', '')) AS text FROM documents"""


@query("line_joining", BROKEN)
def line_joining(spark, sf_dir):
    lines = F.split(F.replace(F.col("text"), F.lit("en "), F.lit("en-\n")), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", bl.join_lines(lines, F.lit(None).cast("array<string>")).alias("text"))


@query("text_blocks", f"""WITH {LINES}, p AS (SELECT doc_id AS doc, n AS block_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM lines), q AS (SELECT * FROM p WHERE text <> ''),
 l AS (SELECT *, lag(text) OVER (PARTITION BY doc ORDER BY block_no) AS p, text[1] AS c FROM q),
 m AS (SELECT *, CASE WHEN p IS NULL THEN 1 WHEN ends_with(p, '-') THEN 0 WHEN regexp_matches(p, '[.!?]["'')\\]”’]*$') THEN 1 WHEN (lower(c) = c AND upper(c) <> c) OR c IN (';', ',', ')', ']') THEN 0 ELSE 1 END AS starts FROM l),
 i AS (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY block_no) AS island FROM m) SELECT doc, island::BIGINT AS block_no, 1::INTEGER AS page, string_agg(text, ' ' ORDER BY block_no) AS text FROM i GROUP BY doc, island""")
def text_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text"))
    return bl.blocks_from_text(pages)


@query("paragraph_source", f"WITH {LINES} SELECT doc_id AS doc, n AS block_no, CASE WHEN doc_id % 3 = 0 THEN 'words' ELSE 'text' END AS origin FROM lines WHERE length(line) >= 80")
def paragraph_source(spark, sf_dir):
    rows = _lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("n").cast("long").alias("block_no"), F.lit(1).alias("page"), F.col("line").alias("text"))
    # Some papers have coordinates; the others' blocks come of their text.
    return bl.paragraphs(rows.where("doc % 3 = 0").withColumn("origin", F.lit("words")), rows.withColumn("origin", F.lit("text"))).select("doc", "block_no", "origin")


@query("relation_texts", "SELECT p_partkey AS seq, trim('The ' || p_brand || ' one holds ' || repeat('x', (p_partkey % 7)::INTEGER)) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' Defined by ' || p_type END AS text FROM part")
def relation_texts(spark, sf_dir):
    return _relations(spark, sf_dir).select("seq", tx.relation_text(F.col("description"), F.col("definition")).alias("text"))


# --- retrieval, index, progress --------------------------------------------------------------


@query("retrieved_sources", f"""WITH {V}, s AS (SELECT q.id AS query, p.corpus, p.id, list_dot_product(q.e, p.e) AS score FROM v q JOIN v p ON q.id % 10 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY score DESC, id) AS rank FROM s) SELECT query, corpus, 'f' || id AS file, round_even(score, 3) AS score FROM r WHERE rank <= 3 AND score >= 0""")
def retrieved_sources(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("text", F.lit("t")).withColumn("source_file", F.concat(F.lit("f"), F.col("id").cast("string")))
    found = retrieval.retrieve(v, v.where("id % 10 = 0"), 3)
    return found.select("query", F.explode(retrieval.rag_sources(F.col("passages"))).alias("s")).select("query", "s.*")


def letters(texts: list[str]) -> np.ndarray:
    """An encoder that SQL can be: how many of some letters there are, length one."""
    x = np.array([[t.count(c) for c in "aeinr"] for t in texts], float).reshape(-1, 5)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@query("encoded", """WITH c AS (SELECT conv_id, turn, 'query: ' || text AS t FROM conversations), n AS (SELECT conv_id, turn, list_transform(['a', 'e', 'i', 'n', 'r'], lambda x: (length(t) - length(replace(t, x, '')))::DOUBLE) AS x FROM c)
 SELECT conv_id, turn, list_transform(x, lambda y: round(y / sqrt(list_sum(list_transform(x, lambda z: z * z))), 4)) AS vector FROM n""")
def encoded(spark, sf_dir):
    e = retrieval.encode(table(spark, sf_dir, "conversations"), "text", letters, "query: ", kind="double")  # rounded once, from doubles, as SQL does
    return e.select("conv_id", "turn", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query("index_refresh", """WITH p AS (SELECT page_id, source_file, h, unnest(string_split(t, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS n FROM (SELECT doc_id AS page_id, 'd' || doc_id AS source_file, replace(text, chr(10), chr(10) || chr(10)) AS t, doc_id % 5 = 0 OR doc_id % 11 = 0 AS h FROM documents WHERE doc_id % 7 <> 0)),
 c AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS text FROM p), k AS (SELECT source_file, (row_number() OVER (PARTITION BY source_file ORDER BY n) - 1)::INTEGER AS chunk_index, text, h FROM c WHERE length(text) >= 80)
 SELECT 'lib' AS corpus, source_file, chunk_index, text, CASE WHEN h THEN 'made' ELSE 'kept' END AS origin FROM k""".replace("\\\\", "\\"))
def index_refresh(spark, sf_dir):
    """Files of which a seventh is gone, a fifth has changed and an eleventh is new; what is kept has the vectors it had."""
    d = F.col("doc_id")
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    docs = table(spark, sf_dir, "documents").select(F.lit("lib").alias("corpus"), F.concat(F.lit("d"), d.cast("string")).alias("source_file"), d, body.alias("content"))
    files = docs.where(d % 7 != 0)
    before = docs.where(d % 11 != 0).withColumn("content", F.when(d % 5 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    old = index.chunks(before).withColumn("vector", F.array(F.lit(0.0).cast("float")))
    new, _ = index.refresh(old, files, index.manifest(before), letters)
    return new.select("corpus", "source_file", "chunk_index", "text", F.when(F.size("vector") == 1, "kept").otherwise("made").alias("origin"))


@query("progress_log", "SELECT doc_id AS source_pdf, quality + 1 AS paragraph_index, true AS valid, true AS finished FROM labels UNION SELECT doc_id, 1, false, false FROM labels WHERE false")
def progress_log(spark, sf_dir):
    lines = table(spark, sf_dir, "labels").select(F.lit("s").alias("signature"), F.col("doc_id").alias("source_pdf"), (F.col("quality") + 1).alias("paragraph_index"), F.lit(None).cast("string").alias("event"))
    end = spark.createDataFrame([("s", None, None, "finished")], "signature string, source_pdf long, paragraph_index int, event string")
    log = lines.unionByName(lines).unionByName(end)
    p, other = checkpoint.progress(log, "s"), checkpoint.progress(log, "t")
    done = p.done.unionByName(other.done)  # that of another signature is empty
    return done.select(F.col("source_pdf"), F.col("paragraph_index"), F.lit(p.valid and not other.valid).alias("valid"), F.lit(p.finished and not other.finished).alias("finished"))


@query("resume_decisions", """WITH r AS (SELECT DISTINCT conv_id AS run, conv_id % 5 <> 0 AS raw, conv_id % 11 = 0 AS again FROM conversations),
 l AS (SELECT conv_id AS run, bool_or(conv_id % 7 = 0 AND turn > 1) AS other, bool_or(turn >= 4 AND role = 'user') AS finished, bool_or(conv_id % 3 <> 0 AND role = 'user') AS done FROM conversations WHERE conv_id % 13 <> 0 GROUP BY 1)
 SELECT run, CASE WHEN again OR NOT raw OR coalesce(other, false) THEN 'discard' WHEN finished THEN 'reuse' WHEN done THEN 'resume' ELSE 'discard' END AS decision FROM r LEFT JOIN l USING (run)""")
def resume_decisions(spark, sf_dir):
    """What to do with the run that each conversation stands for: its turns are the lines of the run's log; some runs have none."""
    c, i, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    runs = c.select(i.alias("run"), F.lit("s").alias("signature"), (i % 5 != 0).alias("raw_exists"), (i % 11 == 0).alias("restart")).distinct()
    said = F.when((i % 3 != 0) & (F.col("role") == "user"), i)
    logs = c.where(i % 13 != 0).select(
        i.alias("run"), F.when((i % 7 != 0) | (t <= 1), "s").otherwise(F.when(t % 2 == 0, "t")).alias("signature"), said.alias("source_pdf"), t.alias("paragraph_index"), F.when((t >= 4) & (F.col("role") == "user"), "finished").alias("event")
    )
    return checkpoint.decisions(runs, logs)


# --- prompts, models, answers ----------------------------------------------------------------


@query("prompt_sections", "SELECT item_id, 'c' || item_id AS name, trim(replace(text, chr(10), ' ')) AS definition, 'e' || item_id || ' and more' AS example, 'How' AS narrative, 'Is c' || item_id || ' it?' AS question FROM benchmark")
def prompt_sections(spark, sf_dir):
    """A prompt file made of each item: its sections, the class in one of them, and the other one rendered."""
    text = "ignored\n@@@ relation_categories @@@\n$$ c{0} $$\n[definition] {1}\n[example] e{0}\nand more\n[narrative] How\n@@@ ask @@@\nIs $name it{{{{#more}}}}, or $other{{{{/more}}}}?"

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for i, t in zip(b["item_id"], b["text"]):
                said = text.format(i, t.replace("\n", " "))
                c = prompts.categories_of(said)[0]
                rows.append((i, c.name, c.definition, c.example, c.narrative, prompts.render(prompts.split_sections(said)["ask"], {"name": c.name})))
            yield pd.DataFrame(rows, columns=["item_id", "name", "definition", "example", "narrative", "question"])

    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(run, "item_id long, name string, definition string, example string, narrative string, question string")


@query("request_totals", "SELECT 'both' AS options, (SELECT count(*) FROM conversations) * 12 AS n UNION ALL SELECT 'classes', (SELECT count(*) FROM conversations) * 11 UNION ALL SELECT 'reading', (SELECT count(*) FROM conversations) * 2 UNION ALL SELECT 'open', (SELECT count(*) FROM conversations)")
def request_totals(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").agg(F.count("*").alias("k"))
    options = [("both", True, True), ("classes", True, False), ("reading", False, True), ("open", False, False)]
    each = spark.createDataFrame([(o, prompts.requests_per_snippet(c, r, len(validate.CLASSES))) for o, c, r in options], "options string, each long")
    return each.crossJoin(F.broadcast(n)).select("options", (F.col("each") * F.col("k")).alias("n"))  # one row


LISTED = "'Relation ' || i || ':' || chr(10) || 'Name: ' || name || chr(10) || 'Description: ' || description || chr(10) || 'Definition: ' || definition || chr(10) || 'Type: ' || relation_type || chr(10) || 'Usage: ' || usage_example"
#: Fixed SQL: the relations of parts as the queries make them.
RELATIONS = "SELECT p_partkey AS seq, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, 'The ' || p_brand || ' one holds ' || repeat('x', (p_partkey % 7)::INTEGER) AS description, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Defined by ' || p_type END AS definition, p_type AS relation_type, p_brand || ' | ' || p_name || ' | ' || p_type AS usage_example, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS i FROM part"


@query("judging_prompts", f"""WITH r AS ({RELATIONS}), l AS (SELECT p_brand AS brand, count(*) AS n, string_agg({LISTED}, chr(10) || chr(10) ORDER BY i) AS listed, arg_min(relation_type, i) AS kind FROM r GROUP BY p_brand),
 s AS (SELECT p_brand AS brand, {LISTED} AS one FROM r WHERE i = 1)
 SELECT brand, 'These ' || n || ' relations are of the class ' || kind || '. Group those of one meaning.' || chr(10) || chr(10) || listed || chr(10) || chr(10) || 'Answer with JSON: {{"groups": [{{"members": [1], "name": "", ...}}]}}, each number in one group.' AS merge,
  'Group those of these ' || n || ' relations that mean the same.' || chr(10) || chr(10) || listed || chr(10) || chr(10) || 'Answer with JSON: {{"groups": [{{"members": [1], "name": "", ...}}]}}, each number in one group.' AS merge_global,
  'Do both relations mean the same?' || chr(10) || chr(10) || one || chr(10) || chr(10) || one || chr(10) || chr(10) || 'Answer with JSON: same_meaning, name, description, definition, relation_type, usage_example (null unless they do), comments.' AS same FROM l JOIN s USING (brand)""")
def judging_prompts(spark, sf_dir):
    r = _relations(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("brand")), "seq")
    listed = r.groupBy("brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", *validate.REQUIRED))), lambda x: F.struct(*[x[f].alias(f) for f in validate.REQUIRED])).alias("r"))
    first = F.col("r")[0]
    return listed.select("brand", prompts.merge_prompt(F.col("r"), True).alias("merge"), prompts.merge_prompt(F.col("r"), False).alias("merge_global"), prompts.same_prompt(first, first).alias("same"))


@query("reading_prompts", "SELECT conv_id, turn, 'Read the passage. Answer in three lines.' || chr(10) || 'Verbs: verbs of the passage, separated by ;' || chr(10) || 'Reading: what the passage says, in plain words' || chr(10) || 'Links: a | verb | b, separated by ;' || chr(10) || chr(10) || 'Passage:' || chr(10) || text AS prompt FROM conversations")
def reading_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.reading_prompt(F.col("text")).alias("prompt"))


OWN = """@@@ extract @@@
{{#context}}$$known:
$snippets
{{/context}}${relation_type}x: $chunk_text
@@@ disambiguate @@@
$name1|$usage_example1|${definition2}
@@@ unused @@@
$whatever"""


@query("own_prompts", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '$known:' || chr(10) || 'role (1):' || chr(10) || '- ' || role || chr(10) ELSE '' END || role || 'x: ' || text AS extract, text || '|u|' || role AS same FROM conversations""")
def own_prompts(spark, sf_dir):
    """Prompts by the templates of a prompt file; sections it does not have are ours."""
    own = prompts.Templates.of(prompts.all_sections([OWN]))
    c = table(spark, sf_dir, "conversations")
    item = F.struct(F.col("role").alias("text"), F.lit("f").alias("source_file"), F.lit(1.0).alias("score"))
    found = F.create_map(F.lit("role"), F.when(F.col("turn") % 2 == 0, F.array(item)).otherwise(F.array().cast("array<struct<text:string,source_file:string,score:double>>")))
    blank = F.lit("")
    a = F.struct(F.col("text").alias("name"), blank.alias("description"), F.col("role").alias("definition"), blank.alias("relation_type"), F.lit("u").alias("usage_example"))
    extract = prompts.extraction_prompt(found, blank, F.col("text"), F.col("role"), blank, blank, blank, own)
    return c.select("conv_id", "turn", extract.alias("extract"), prompts.same_prompt(a, a, own).alias("same"))


def _moody() -> model.Stub:
    """A model that answers, answers nothing, fails or thinks, as the prompt's first word says."""

    def answer(prompt: str) -> str:
        if prompt.startswith("fail"):
            raise OSError("down")
        return "" if prompt.startswith("cut") else prompt

    return model.Stub(answer)


@query("model_calls", "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'say ' || text ELSE '' END AS answer, CASE turn % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'truncated' ELSE 'blank' END AS status, CASE turn % 4 WHEN 1 THEN 2 WHEN 3 THEN 0 ELSE 1 END::INTEGER AS requests FROM conversations")
def model_calls(spark, sf_dir):
    k = F.col("turn") % 4
    prompt = F.when(k == 0, F.concat(F.lit("say "), "text")).when(k == 1, F.concat(F.lit("fail "), "text")).when(k == 2, F.concat(F.lit("cut "), "text")).otherwise(F.lit(" "))
    out = model.ask_all(table(spark, sf_dir, "conversations").withColumn("prompt", prompt), _moody, attempts=2, pause=0)
    return out.select("conv_id", "turn", "answer", "status", "requests")


@query("context_windows", """WITH c AS (SELECT conv_id, turn, ceil(length(text) * (CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 40 ELSE 400 END) / 3)::BIGINT AS tokens FROM conversations)
 SELECT conv_id, turn, tokens, least(ceil((tokens + 2048) / 512)::BIGINT * 512, 32768) AS size FROM c""")
def context_windows(spark, sf_dir):
    def run(batches):
        for b in batches:
            w = [(model.Window().estimate(t), model.Window().needed(t)) for t in b["text"]]
            yield b.assign(tokens=[x for x, _ in w], size=[y for _, y in w])[["conv_id", "turn", "tokens", "size"]]

    k = F.col("turn") % 3
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.repeat("text", F.when(k == 0, 1).when(k == 1, 40).otherwise(400)).alias("text"))
    return c.mapInPandas(run, "conv_id long, turn long, tokens long, size long")


MERGED = '{"groups": [{"members": [1, "2"], "name": "N"}, {"members": [3.0]}]}'
PARTITIONS = {0: MERGED, 1: '{"groups": [{"members": [1, 2]}]}', 2: '{"groups": [{"members": [1, 1, 2]}, {"members": [3]}]}', 3: '[{"members": [1, 2, 3]}]', 4: '{"groups": [{"members": [1, 2]}, {"members": [2, 3]}]}', 5: '{"groups": [{"members": [0, 1, 2, 3]}]}'}


@query("merge_partitions", "SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN [[1, 2], [3]] WHEN 2 THEN [[1, 1, 2], [3]] END AS groups FROM conversations")
def merge_partitions(spark, sf_dir):
    @F.pandas_udf("array<array<int>>")
    def run(said):
        import pandas as pd

        found = [answers.merge_groups(answers.answer_value(answers.plain_answer(t)), 3) for t in said]
        return pd.Series([None if g is None else [x["members"] for x in g] for g in found])

    text = F.coalesce(*[F.when(F.col("turn") % 6 == i, F.concat(F.lit("<think>"), "role", F.lit("</think>```json\n" + t + "\n```"))) for i, t in PARTITIONS.items()])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", run(text).alias("groups"))


@query("same_meanings", "SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'kept' WHEN 4 THEN 'Once' END AS description FROM conversations")
def same_meanings(spark, sf_dir):
    good = {"name": "part_of", "description": "kept", "definition": "d", "relation_type": "Subsumption", "usage_example": "a | part of | b"}
    said = [{"same_meaning": True, "description": "Yes. More"}, {"same_meaning": 1, "description": None}, {"same_meaning": False}, {"same_meaning": True, "name": "1"}, {"same_meaning": "false", "description": "Once; twice"}]

    def run(batches):
        for b in batches:
            got = [judges.same_judge(lambda t=t: model.Stub(lambda p: json.dumps(said[t % 5])), pause=0)(good, good) for t in b["turn"]]
            yield b.assign(description=[g and g["description"] for g in got])[["conv_id", "turn", "description"]]

    return table(spark, sf_dir, "conversations").mapInPandas(run, "conv_id long, turn long, description string")


@query("run_names", """WITH m AS (SELECT doc_id, coalesce(source, 'none') AS model, list_filter([CASE WHEN doc_id % 2 = 1 THEN 'sentences' END, CASE WHEN doc_id % 3 = 0 THEN 'norag' END, CASE WHEN doc_id % 5 = 0 THEN 'openclasses' END, CASE WHEN doc_id % 7 = 0 THEN 'noreading' END], lambda x: x IS NOT NULL) AS marks FROM documents)
 SELECT doc_id, model || CASE WHEN len(marks) > 0 THEN '[' || array_to_string(marks, '+') || ']' ELSE '' END AS signature FROM m""")
def run_names(spark, sf_dir):
    """The name of a run for each document: of a model named after its source, with options by its number."""

    def run(batches):
        for b in batches:
            told = [Options(m, "sentence" if d % 2 else "paragraph", d % 3 != 0, d % 5 != 0, d % 7 != 0).signature() for d, m in zip(b["doc_id"], b["model"])]
            yield b.assign(signature=told)[["doc_id", "signature"]]

    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("model")).mapInPandas(run, "doc_id long, signature string")


@query("duplicate_keys", "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return prompts.duplicate_keys(table(spark, sf_dir, "conversations"), "conv_id", "role")


# --- similar names: the Ratcliff-Obershelp ratio by recursion -------------------------------


def _ratio(pairs: str) -> str:
    """Fixed SQL: ratio(a, b, r) of a table of pairs. The longest common run, the earliest in a and then in b, splits both strings again and again."""
    prefix = "len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n)))"
    return f"""blocks_(a, b, alo, ahi, blo, bhi, gain) AS (SELECT a, b, 0::BIGINT, length(a), 0::BIGINT, length(b), 0::BIGINT FROM {pairs} UNION ALL
  SELECT a, b, CASE WHEN h = 0 THEN alo ELSE best.k - best.i END, CASE WHEN h = 0 THEN -best.i ELSE ahi END, CASE WHEN h = 0 THEN blo ELSE best.k - best.j END, CASE WHEN h = 0 THEN -best.j ELSE bhi END, CASE WHEN h = 0 THEN best.k ELSE 0 END
  FROM (SELECT a, b, alo, ahi, blo, bhi, list_sort(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: {{'k': {prefix}, 'i': -i, 'j': -j}}))))[-1] AS best FROM blocks_ WHERE ahi > alo AND bhi > blo), (VALUES (0), (1)) t(h) WHERE best.k > 0),
 ratio AS (SELECT a, b, 2.0::DOUBLE * sum(gain) / (length(a) + length(b)) AS r FROM blocks_ GROUP BY a, b)"""


def _groups(least: float, cls: str) -> str:
    """Fixed SQL: the leader of each distinct name (and class): names join the first leader before them that is similar."""
    return f"""named AS (SELECT lower(p_name) AS key, {cls} AS class, min(p_partkey) AS seq FROM part GROUP BY ALL),
 pairs AS (SELECT DISTINCT x.key AS a, y.key AS b FROM named x JOIN named y ON x.seq < y.seq AND x.class = y.class AND x.key <> y.key), {_ratio("pairs")},
 sim AS (SELECT a, b FROM ratio WHERE r >= {least} OR a = b || 's' OR b = a || 's'),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY seq) AS k FROM named),
 near AS (SELECT y.class, y.seq, list(x.seq) AS before FROM ranked y JOIN sim ON sim.b = y.key JOIN ranked x ON x.key = sim.a AND x.class = y.class AND x.seq < y.seq GROUP BY ALL),
 fold(class, k, l) AS (SELECT class, 1, [seq] FROM ranked WHERE k = 1 UNION ALL SELECT f.class, f.k + 1, CASE WHEN list_has_any(f.l, coalesce(n.before, [])) THEN f.l ELSE list_append(f.l, y.seq) END FROM fold f JOIN ranked y ON y.class = f.class AND y.k = f.k + 1 LEFT JOIN near n ON n.class = y.class AND n.seq = y.seq),
 leaders AS (SELECT class, arg_max(l, k) AS l FROM fold GROUP BY class),
 grouped AS (SELECT y.key, y.class, coalesce(list_min(list_intersect(n.before, l)), y.seq) AS group_seq FROM ranked y JOIN leaders USING (class) LEFT JOIN near n ON n.class = y.class AND n.seq = y.seq)"""


NAMES = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("name_groups", f"WITH RECURSIVE {_groups(0.70, chr(39) * 2)} SELECT p_partkey AS seq, {NAMES} AS name, group_seq FROM part JOIN grouped ON key = lower(p_name)")
def name_groups(spark, sf_dir):
    return resolve.group_by_name(_relations(spark, sf_dir), False, 0.70).select("seq", "name", "group_seq")


@query("name_groups_by_class", f"WITH RECURSIVE {_groups(0.85, 'p_type')} SELECT p_partkey AS seq, {NAMES} AS name, p_type AS relation_type, group_seq FROM part JOIN grouped ON key = lower(p_name) AND class = p_type")
def name_groups_by_class(spark, sf_dir):
    return resolve.group_by_name(_relations(spark, sf_dir), True).select("seq", "name", "relation_type", "group_seq")


def _merge_all(batch: list[dict]) -> list[dict]:
    """A stand-in judge: a batch is one relation, the first, with the shortest description."""
    return [batch[0] | {"description": min((r["description"] for r in batch), key=len)}]


@query("merge_names", f"""WITH RECURSIVE {_groups(0.85, 'p_type')}, r AS (SELECT q.*, group_seq FROM ({RELATIONS}) q JOIN grouped ON key = lower(name) AND class = relation_type),
 m AS (SELECT group_seq, count(*) AS n, arg_min(description, length(description) * 1000000000 + seq) AS d FROM r GROUP BY group_seq)
 SELECT r.seq + CASE WHEN n > 1 THEN 2305843009213693952 ELSE 0 END AS seq, name, d AS description, definition, relation_type, usage_example, 1::BIGINT AS n_folded FROM r JOIN m ON r.seq = m.group_seq""")
def merge_names(spark, sf_dir):
    return resolve.merge_by_name(_relations(spark, sf_dir), True, _merge_all)


#: Fixed SQL: each part's name with the next part's, with its plural, and with what is left of it without its beginning.
PAIRS = "pairs AS (SELECT lower(x.p_name) AS a, lower(y.p_name) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1 UNION SELECT lower(p_name), lower(p_name) || 's' FROM part UNION SELECT lower(p_name), lower(p_name)[4:] FROM part)"


@query("similar_names", f"WITH RECURSIVE {PAIRS}, {_ratio('pairs')} SELECT a, b, a = b OR r >= 0.85 AS close, a = b OR contains(a, b) OR contains(b, a) OR r >= 0.75 AS same_entity, replace(a, ' ', '_') = replace(b, ' ', '_') OR r >= 0.6 AS predicate FROM ratio")
def similar_names_(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"))
    beside = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey").select("a", "b")
    both = beside.unionByName(p.select("a", F.concat("a", F.lit("s")).alias("b"))).unionByName(p.select("a", F.expr("substring(a, 4)").alias("b"))).distinct()
    x, y = F.col("a"), F.col("b")
    return both.select("a", "b", similar_names(x, y).alias("close"), same_entity(x, y).alias("same_entity"), predicate_matches(x, F.replace(y, F.lit(" "), F.lit("_"))).alias("predicate"))


@query("name_keys", f"SELECT p_partkey, {NAME_KEY.format(chr(39) + '  ' + chr(39) + ' || p_name')} AS key FROM part")
def name_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.name_key(F.concat(F.lit("  "), "p_name")).alias("key"))


# --- reading notes ---------------------------------------------------------------------------


def _in_source(x: str) -> str:
    """Fixed SQL: whether a phrase is in the text ``t``, whose words are ``there``."""
    q = rf"trim(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'))"
    words = rf"list_filter(regexp_split_to_array({q}, '\s+'), lambda y: length(y) > 2)"
    return f"({q} <> '' AND (contains(t, {q}) OR len({words}) = 0 OR len(list_filter({words}, lambda y: list_contains(there, y))) / len({words}) >= 0.6))"


_EMPTY = "('none', 'nenhum', 'n/a', '-', '—', '')"
_PARTS = "list_transform(string_split({0}, '|'), lambda z: trim(z))"
_LAST = "CASE WHEN contains(head, '{0}') THEN length(head) - strpos(reverse(head), reverse('{0}')) - 1 ELSE -1 END"


@query("reading_notes", rf"""WITH c AS (SELECT conv_id, turn, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS w, regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g') AS t FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)),
 a AS (SELECT conv_id, turn, t, regexp_split_to_array(t, '\s+') AS there, coalesce(w[2], 'none') || '; ' || coalesce(w[3], 'none') || '; none; ' || coalesce(w[2], 'none') AS verbs, trim(regexp_replace(text, '\s+', ' ', 'g')) AS said,
   coalesce(w[1], 'none') || ' | is | ' || coalesce(w[4], 'none') || '; a | b; zz | is | qq' AS links FROM c),
 b AS (SELECT *, left(said, 600) AS head, list_filter(list_transform(string_split(verbs, ';'), lambda x: trim(regexp_replace(trim(x), '^"+|"+$', '', 'g'))), lambda x: lower(x) NOT IN {_EMPTY} AND {_in_source("x")}) AS v,
   list_filter(list_transform(string_split(links, ';'), lambda x: trim(x)), lambda x: lower(x) NOT IN {_EMPTY}) AS e FROM a),
 d AS (SELECT *, list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i) AS vd, list_filter(e, lambda x: len({_PARTS.format("x")}) = 3 AND {_PARTS.format("x")}[1] <> '' AND {_PARTS.format("x")}[2] <> '' AND {_PARTS.format("x")}[3] <> '' AND {_in_source(_PARTS.format("x") + "[1]")} AND {_in_source(_PARTS.format("x") + "[3]")}) AS g,
   CASE WHEN length(said) <= 600 THEN said WHEN greatest({_LAST.format(". ")}, {_LAST.format("; ")}) > 0 THEN trim(left(head, greatest({_LAST.format(". ")}, {_LAST.format("; ")}) + 1)) WHEN contains(head, ' ') THEN trim(left(head, length(head) - strpos(reverse(head), ' '))) ELSE head END AS reading FROM b)
 SELECT conv_id, turn, len(e) - len(g) AS dropped, CASE WHEN reading = '' AND len(g) = 0 THEN '' ELSE concat_ws(chr(10), CASE WHEN len(vd) > 0 THEN 'Verbs: ' || array_to_string(vd, '; ') END, CASE WHEN reading <> '' THEN 'Reading: ' || reading END,
   'Links: ' || CASE WHEN len(g) > 0 THEN array_to_string(list_transform(g, lambda x: array_to_string({_PARTS.format("x")}, ' | ')), '; ') ELSE 'none' END) END AS notes FROM d""")
def reading_notes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))  # a label's text is one line
    w = F.filter(F.split("text", " "), lambda x: x != "")
    word = lambda i: F.coalesce(F.get(w, i), F.lit("none"))
    answer = F.concat(F.lit("Verbs: "), word(1), F.lit("; "), word(2), F.lit("; none; "), word(1), F.lit("\nReading: "), "text", F.lit("\nlinks - "), word(0), F.lit(" | is | "), word(3), F.lit("; a | b; zz | is | qq"))
    c = c.withColumn("answer", answer)
    return c.select("conv_id", "turn", notes.notes(F.col("answer"), F.col("text")).alias("notes"), notes.dropped_links(notes.labelled(F.col("answer"), "links"), F.col("text")).cast("long").alias("dropped"))
