"""Named queries over the driver's tables, each with DuckDB SQL that must give the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import text as tx
from folioloom.functions.similarity import is_in_source
from folioloom.operators import blocks as bl
from folioloom.operators import checkpoint, index, layout, resolve, retrieval, validate
from folioloom.plans import answers, knowledge, model, prompts
from folioloom.plans.run import Options
from folioloom.sources.documents import text_pages
from folioloom.sources.store import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed SQL: sentences of a text column in DuckDB, whose regular expressions have no look-behind.
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim({0}, chr(32)||chr(10)), '([.!?])\s+', '\1'||chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32)||chr(10))), lambda s: s <> '')"


@query(
    "sentence_fold",
    f"""WITH s AS (SELECT doc_id, unnest({SENTENCES.format('text')}) AS sentence FROM documents),
     k AS (SELECT doc_id, sentence, lower(trim(regexp_replace(sentence, '\\s+', ' ', 'g'))) AS key FROM s WHERE length(sentence) >= 30)
SELECT key, min(doc_id) AS first_doc, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, min(length(sentence)) AS shortest FROM k GROUP BY key""",
)
def sentence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = docs.select("doc_id", F.explode(tx.passage_sentences(F.col("text"), 30)).alias("sentence"))
    return (
        s.select("doc_id", "sentence", tx.name_key(F.col("sentence")).alias("key"))
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("first_doc"),
            F.count("*").alias("n_rows"),
            F.countDistinct("doc_id").alias("n_docs"),
            F.min(F.length("sentence")).alias("shortest"),
        )
    )


#: Fixed SQL: white space of the fixtures is space and newline.
NAME_KEY = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
SNAKE = r"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(trim({0})), '[ \-]', '_', 'g'), '[^a-z_]', '', 'g'), '_'), lambda w: w <> '')[1:3], '_')"


@query("sentence_split", f"""SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS n FROM (
  SELECT doc_id, CASE WHEN len(k) > 0 THEN k ELSE [text] END AS s FROM (SELECT doc_id, text, list_filter({SENTENCES.format("text")}, lambda x: length(x) >= 30) AS k FROM documents))""")
def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(tx.snippet_sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", (F.col("n") + 1).cast("long"))


@query("passages", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
 c AS (SELECT doc_id, n, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM p)
 SELECT doc_id, t AS text, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS paragraph_index FROM c WHERE length(t) >= 80""")
def passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # The tables have no blank lines: each newline becomes one.
    parts = docs.select("doc_id", F.posexplode(tx.paragraphs_of(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))).alias("n", "text"))
    return parts.select("doc_id", "text", (F.col("n") + 1).cast("long").alias("paragraph_index"))


@query("text_normalize", f"""SELECT conv_id, turn, {NAME_KEY.format("text")} AS name_key, {SNAKE.format("text")} AS snake,
 trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS plain, regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g') AS words,
 lower(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS running, regexp_matches({SNAKE.format("text")}, '^[a-z]+(_[a-z]+){{0,2}}$') AS named FROM conversations""")
def text_normalize(spark, sf_dir):
    t = F.col("text")
    snake = tx.snake_name(t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.name_key(t).alias("name_key"), snake.alias("snake"), tx.plain_text(t).alias("plain"), tx.word_text(t).alias("words"), tx.running_form(t).alias("running"), tx.is_snake_name(snake).alias("named"))


@query("ligatures", "SELECT item_id, text AS text FROM benchmark")
def ligatures(spark, sf_dir):
    text = F.col("text")
    for glyph in ("ﬃ", "ﬄ", "ﬀ", "ﬁ", "ﬂ"):
        text = F.replace(text, F.lit(tx.LIGATURES[glyph]), F.lit(glyph))
    return table(spark, sf_dir, "benchmark").select("item_id", tx.expand_ligatures(text).alias("text"))


@query("triples", r"""WITH t AS (SELECT item_id, trim(replace(replace(text, ' the ', ' | '), chr(10), ' ')) AS t FROM benchmark),
 e AS (SELECT item_id, t, length(t) - length(replace(t, '|', '')) AS pipes, regexp_extract(t, '^(.+?)(?:\s*[|–—,;]\s*|\s+[-–—]\s+)(.+?)(?:\s*[|–—,;]\s*|\s+[-–—]\s+)(.+)$', ['a', 'b', 'c']) AS m FROM t)
 SELECT item_id, CASE WHEN pipes = 2 OR trim(m.a) = '' OR trim(m.b) = '' OR trim(m.c) = '' THEN t ELSE trim(m.a) || ' | ' || trim(m.b) || ' | ' || trim(m.c) END AS triple FROM e""")
def triples(spark, sf_dir):
    text = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" | ")), F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "benchmark").select("item_id", tx.tidy_triple(text).alias("triple"))


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


def _lines(spark, sf_dir, dealt=False):
    docs = table(spark, sf_dir, "documents")
    if dealt:  # a document's lines and words stay where it is put, so that grouping them by document moves nothing
        docs = docs.repartition("doc_id")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


@query("recurring_lines", f"""WITH {LINES} SELECT lower(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS form, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM lines GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""")
def recurring_lines(spark, sf_dir):
    forms = _lines(spark, sf_dir).select("doc_id", tx.running_form(F.col("line")).alias("form"))
    return forms.groupBy("form").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_lines")).where("n_docs >= 3")


@query("header_filter", f"""WITH {LINES} SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM lines WHERE NOT (regexp_full_match(trim(line), '[0-9]+') OR contains(lower(line), 'ononen') OR starts_with(lower(line), 'the ')) GROUP BY doc_id""")
def header_filter(spark, sf_dir):
    kept = _lines(spark, sf_dir).where(~tx.is_header_or_footer(F.lower("line"), ["ononen"], ["the "]))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


#: Fixed SQL: lines as blocks, four to a page, with headings put in by the document's number.
BLOCKS = LINES + """, blocks AS (SELECT doc_id AS doc, n AS block_no, (n - 1) // 4 + 1 AS page, CASE
   WHEN n = 3 AND doc_id % 3 = 0 THEN 'Introduction' WHEN n = 3 AND doc_id % 3 = 1 THEN '1. Introduction ' || line WHEN n = 3 THEN 'INTRODUCTION ' || line
   WHEN n = 9 AND doc_id % 2 = 0 THEN 'References' WHEN n = 9 AND doc_id % 4 = 1 THEN 'Bibliography ' || line ELSE line END AS text FROM lines)"""


def _blocks(spark, sf_dir):
    n, d, line = F.col("n"), F.col("doc_id"), F.col("line")
    text = (
        F.when((n == 3) & (d % 3 == 0), "Introduction").when((n == 3) & (d % 3 == 1), F.concat(F.lit("1. Introduction "), line)).when(n == 3, F.concat(F.lit("INTRODUCTION "), line))
        .when((n == 9) & (d % 2 == 0), "References").when((n == 9) & (d % 4 == 1), F.concat(F.lit("Bibliography "), line)).otherwise(line)
    )
    return _lines(spark, sf_dir).select(d.alias("doc"), n.alias("block_no"), (F.floor((n - 1) / 4) + 1).cast("int").alias("page"), text.alias("text"))


@query("front_back_cut", f"""WITH {BLOCKS},
 f AS (SELECT *, CASE WHEN block_no = 3 AND page <= 3 THEN CASE WHEN doc % 3 = 0 THEN '' ELSE trim(regexp_replace(text, '^(1\\. Introduction|INTRODUCTION)\\s+', '')) END END AS body FROM blocks),
 g AS (SELECT *, min(CASE WHEN body IS NOT NULL THEN block_no END) OVER (PARTITION BY doc) AS head FROM f),
 h AS (SELECT doc, block_no, page, CASE WHEN block_no = head THEN body ELSE text END AS text FROM g WHERE head IS NULL OR block_no > head OR (block_no = head AND body <> '')),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY block_no) AS k FROM h),
 c AS (SELECT *, min(CASE WHEN k > 1 AND block_no = 9 AND doc % 4 <> 3 THEN k END) OVER (PARTITION BY doc) AS cut FROM r)
 SELECT doc, block_no::INTEGER AS block_no, page::INTEGER AS page, text FROM c WHERE cut IS NULL OR k < cut""")
def front_back_cut(spark, sf_dir):
    return bl.body_only(_blocks(spark, sf_dir))


@query("continuations", f"""WITH {BLOCKS},
 l AS (SELECT *, lag(text) OVER (PARTITION BY doc ORDER BY block_no) AS p, text[1] AS c FROM blocks),
 m AS (SELECT *, CASE WHEN p IS NULL THEN 1 WHEN ends_with(p, '-') THEN 0 WHEN regexp_matches(p, '[.!?]["'')\\]”’]*$') THEN 1 WHEN (lower(c) = c AND upper(c) <> c) OR c IN (';', ',', ')', ']') THEN 0 ELSE 1 END AS starts FROM l),
 i AS (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY block_no) AS island FROM m)
 SELECT doc, island::BIGINT AS block_no, min(page)::INTEGER AS page, string_agg(text, ' ' ORDER BY block_no) AS text FROM i GROUP BY doc, island""")
def continuations(spark, sf_dir):
    return bl.join_continuations(_blocks(spark, sf_dir))


@query("snippet_numbers", f"""WITH {BLOCKS}, s AS (SELECT doc, block_no, page, CASE WHEN len(k) > 0 THEN k ELSE [text] END AS s FROM (SELECT *, list_filter({SENTENCES.format("text")}, lambda x: length(x) >= 30) AS k FROM blocks)),
 u AS (SELECT doc, block_no, page, unnest(s) AS text, generate_subscripts(s, 1) AS j FROM s)
 SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY block_no, j)::INTEGER AS paragraph_index, page::INTEGER AS page, text FROM u""")
def snippet_numbers(spark, sf_dir):
    return bl.snippets(_blocks(spark, sf_dir), by_sentence=True)


@query("hyphenations", r"""SELECT doc_id AS doc, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+-[\p{L}\p{M}\p{N}_]+'))) AS hyphenations FROM documents WHERE regexp_matches(lower(text), '[\p{L}\p{M}\p{N}_]-[\p{L}\p{M}\p{N}_]')""")
def hyphenations(spark, sf_dir):
    return bl.hyphenations(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query("form_feed_pages", "SELECT doc, turn, unnest(p) AS text, generate_subscripts(p, 1)::INTEGER AS page FROM (SELECT conv_id AS doc, turn, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS p FROM (SELECT conv_id, turn, string_split(replace(CASE WHEN turn % 3 = 0 THEN text || 'the' ELSE text END, 'the', chr(12)), chr(12)) AS s FROM conversations))")
def form_feed_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("the"))).otherwise(F.col("text"))
    c = c.select(F.struct("conv_id", "turn").alias("doc"), F.replace(text, F.lit("the"), F.lit("\f")).alias("text"))
    return text_pages(c).select("doc.conv_id", "doc.turn", "text", "page").withColumnRenamed("conv_id", "doc")


#: Fixed SQL: words of lines on a grid; a fifth of the documents have a second column far to the right.
WORDS = """ls AS (SELECT doc_id, n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
 ws AS (SELECT doc_id AS doc, n, unnest(w) AS text, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, n, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM ls)),
 words AS (SELECT doc, ((i - 1) // 400 + 1)::INTEGER AS page, n * 100000 + i AS word_no, (CASE WHEN i % 10 >= 5 AND doc % 5 = 0 THEN 600 ELSE 0 END + 60 * (i % 5))::DOUBLE AS x_min, (CASE WHEN i % 10 >= 5 AND doc % 5 = 0 THEN 600 ELSE 0 END + 60 * (i % 5) + 50)::DOUBLE AS x_max,
   (2000 * n + 12 * ((i - 1) // 10) + CASE WHEN doc % 5 <> 0 AND i % 10 >= 5 THEN 6 ELSE 0 END)::DOUBLE AS y_min, text FROM ws)"""


def _words(spark, sf_dir, dealt=False):
    w = _lines(spark, sf_dir, dealt).select(F.col("doc_id").alias("doc"), "n", F.posexplode(F.filter(F.split("line", " "), lambda x: x != "")).alias("i", "text")).withColumn("i", F.col("i") + 1)
    i, d, right = F.col("i"), F.col("doc"), (F.col("i") % 10 >= 5) & (F.col("doc") % 5 == 0)
    x = (F.when(right, 600).otherwise(0) + 60 * (i % 5)).cast("double")
    y = (2000 * F.col("n") + 12 * F.floor((i - 1) / 10) + F.when((d % 5 != 0) & (i % 10 >= 5), 6).otherwise(0)).cast("double")
    return w.select("doc", (F.floor((i - 1) / 400) + 1).cast("int").alias("page"), (F.col("n") * 100000 + i).cast("long").alias("word_no"), x.alias("x_min"), (x + 50).alias("x_max"), y.alias("y_min"), (y + 10).alias("y_max"), "text")


@query("column_cut", f"""WITH {WORDS}, span AS (SELECT doc, page, min(x_min) AS lo, max(x_max) AS hi, count(*) AS n FROM words GROUP BY ALL HAVING count(*) >= 40 AND max(x_max) > min(x_min)),
 t AS (SELECT s.doc, s.page, n, k AS step, lo + (hi - lo) * (0.25::DOUBLE + 0.5::DOUBLE * k / 200) AS cut, x_min, x_max FROM words w JOIN span s ON w.doc = s.doc AND w.page = s.page, range(201) r(k)),
 c AS (SELECT doc, page, n, step, cut, count(*) FILTER (x_max <= cut) AS l, count(*) FILTER (x_min >= cut AND NOT x_max <= cut) AS r, count(*) FILTER (NOT x_max <= cut AND NOT x_min >= cut) AS x FROM t GROUP BY ALL)
 SELECT doc, page, round(arg_min(cut, x / n * 1000 + step), 6) AS cut FROM c WHERE least(l, r) >= 0.25 * n AND x / n < 0.015 GROUP BY ALL""")
def column_cut(spark, sf_dir):
    return layout.column_cuts(_words(spark, sf_dir), ["doc", "page"]).select("doc", "page", F.round("cut", 6).alias("cut"))


@query("line_grouping", f"""WITH {WORDS} SELECT doc, page, min(x_min) AS x_min, max(x_max) AS x_max, y_min, string_agg(text, ' ' ORDER BY x_min, word_no) AS text FROM words GROUP BY doc, page, y_min""")
def line_grouping(spark, sf_dir):
    return layout.group_lines(_words(spark, sf_dir), ["doc", "page"], with_words=False).select("doc", "page", "x_min", "x_max", "y_min", "text")


PARAGRAPHS = f"""WITH {WORDS}, l AS (SELECT doc, page, min(x_min) AS x_min, max(x_max) AS x_max, y_min, y_min + 10 AS y_max, row_number() OVER (PARTITION BY doc, page ORDER BY y_min) - 1 AS line_no FROM words GROUP BY doc, page, y_min),
 g AS (SELECT *, y_min - lag(y_max) OVER w AS gap FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY line_no)),
 e AS (SELECT doc, page, round_even(x_min, 0) AS edge, count(*) AS k FROM l GROUP BY ALL), b AS (SELECT doc, page, arg_max(edge, k * 100000 - edge) AS body_left FROM e GROUP BY ALL),
 s AS (SELECT doc, page, coalesce(median(gap) FILTER (gap >= 0), 0) AS body_gap, max(x_max) AS body_right FROM g GROUP BY ALL),
 j AS (SELECT g.*, body_left, body_gap, body_right, x_max - body_left >= 0.92 * (body_right - body_left) AS full_ FROM g JOIN s USING (doc, page) JOIN b USING (doc, page)),
 k AS (SELECT *, avg(full_::INTEGER) OVER (PARTITION BY doc, page) >= 0.8 AS justified, lag(full_) OVER (PARTITION BY doc, page ORDER BY line_no) AS before FROM j),
 m AS (SELECT *, coalesce(gap > body_gap + 5 OR x_min > body_left + 6 OR (justified AND NOT before), false)::INTEGER AS starts FROM k)
 SELECT doc, page, line_no::INTEGER AS line_no, sum(starts) OVER (PARTITION BY doc, page ORDER BY line_no)::BIGINT AS paragraph FROM m"""


@query("paragraph_grouping", PARAGRAPHS)
def paragraph_grouping(spark, sf_dir):
    lines = layout.group_lines(_words(spark, sf_dir), ["doc", "page"], with_words=False)
    return layout.group_paragraphs(lines, ["doc", "page"]).select("doc", "page", "line_no", "paragraph")


@query("layout_blocks")
def layout_blocks(spark, sf_dir):
    return layout.blocks_from_words(_words(spark, sf_dir, dealt=True))


@query("grounding", r"""WITH p AS (SELECT conv_id, turn, d.text AS source, array_to_string(list_filter(string_split(c.text, ' '), lambda w: w <> '')[1:4], ' ') AS phrase FROM conversations c JOIN documents d ON d.doc_id = c.conv_id),
 w AS (SELECT *, trim(regexp_replace(lower(phrase), '[^a-z0-9\s]', ' ', 'g'), chr(32)||chr(10)) AS q, regexp_replace(lower(source), '[^a-z0-9\s]', ' ', 'g') AS t FROM p),
 h AS (SELECT *, list_filter(regexp_split_to_array(q, '\s+'), lambda x: length(x) > 2) AS long, regexp_split_to_array(t, '\s+') AS there FROM w)
 SELECT conv_id, turn, phrase, CASE WHEN q = '' THEN false WHEN contains(t, q) THEN true WHEN len(long) = 0 THEN true ELSE len(list_filter(long, lambda x: list_contains(there, x))) / len(long) >= 0.6 END AS grounded FROM h""")
def grounding(spark, sf_dir):
    c, d = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")
    phrase = F.array_join(F.slice(F.filter(F.split(c["text"], " "), lambda w: w != ""), 1, 4), " ")
    both = c.join(d, c["conv_id"] == d["doc_id"]).select("conv_id", "turn", phrase.alias("phrase"), d["text"].alias("source"))
    return both.select("conv_id", "turn", "phrase", is_in_source(F.col("phrase"), F.col("source")).alias("grounded"))


def _condensed(t: str, sentences: int, chars: int, semicolons: bool = False) -> str:
    """Fixed SQL: the leading sentences of ``t`` within so many characters; chr(2) marks the end once one does not fit. Only a first one that is too long is cut."""
    parts = SENTENCES.format(t)
    if semicolons:
        parts = parts.replace("'g'), chr(1))", r"'g'), ';\s+', chr(1), 'g'), chr(1))", 1).replace("string_split(regexp_replace", "string_split(regexp_replace(regexp_replace", 1)
    joined = f"replace(list_reduce(({parts})[1:{sentences}], lambda a, x: CASE WHEN ends_with(a, chr(2)) THEN a WHEN length(a) + 1 + length(x) <= {chars} THEN a || ' ' || x ELSE a || chr(2) END), chr(2), '')"
    at = "length(h) - strpos(reverse(h), reverse('{0}')) - length('{0}') + 1"

    def cut(mark: str) -> str:
        return f"WHEN contains(h, '{mark}') AND {at.format(mark)} >= {int(chars * 0.6)} THEN left(h, {at.format(mark)})"

    return (
        f"(SELECT CASE WHEN length(j) <= {chars} THEN j WHEN regexp_matches(z, '[.!?]$') THEN z ELSE z || '.' END FROM (SELECT j, regexp_replace(CASE {cut('; ')} {cut(', ')} WHEN contains(h, ' ') THEN left(h, {at.format(' ')}) ELSE h END, '[ ,;:\\-—]+$', '') AS z"
        f" FROM (SELECT j, left(j, {chars}) AS h FROM (SELECT coalesce({joined}, '') AS j))))"
    )


#: Fixed SQL: short texts without an end, clauses, doubled blanks: what is left as it is and what is split.
SHORT = r"""short AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN left(text, 40) WHEN 2 THEN replace(text, '. ', ';  ') ELSE repeat(left(text, 90) || ', ', 4) END AS t FROM conversations)"""


@query("condense", rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
 SELECT doc_id, {_condensed("t", *validate.DESCRIPTION, True)} AS description, {_condensed("t", *validate.DEFINITION)} AS definition FROM d""")
def condense(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.collapse(F.col("text")).alias("t"))
    return d.select("doc_id", tx.condense(F.col("t"), *validate.DESCRIPTION, True).alias("description"), tx.condense(F.col("t"), *validate.DEFINITION).alias("definition"))


@query("condense_short", rf"""WITH {SHORT}, d AS (SELECT conv_id, turn, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM short)
 SELECT conv_id, turn, {_condensed("t", *validate.DESCRIPTION, True)} AS description, {_condensed("t", *validate.DEFINITION)} AS definition, {_condensed("t", 2, 60)} AS narrow FROM d""")
def condense_short(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.col("turn") % 4
    t = F.when(k == 0, F.col("text")).when(k == 1, F.left("text", F.lit(40))).when(k == 2, F.replace(F.col("text"), F.lit(". "), F.lit(";  "))).otherwise(F.repeat(F.concat(F.left("text", F.lit(90)), F.lit(", ")), 4))
    d = c.select("conv_id", "turn", tx.collapse(t).alias("t"))
    t = F.col("t")
    return d.select("conv_id", "turn", tx.condense(t, *validate.DESCRIPTION, True).alias("description"), tx.condense(t, *validate.DEFINITION).alias("definition"), tx.condense(t, 2, 60).alias("narrow"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("corpus"))


V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label AS corpus FROM embeddings)"
E = f"{V}, edges AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.e, b.e) >= 0.4)"


@query("topk_passages", f"""WITH {V}, s AS (SELECT q.id AS query, p.corpus, p.id, list_dot_product(q.e, p.e) AS score FROM v q JOIN v p ON q.id % 10 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY score DESC, id)::INTEGER AS rank FROM s) SELECT query, corpus, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10 AND score >= 0""")
def topk_passages(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return retrieval.top_passages(v, v.where("id % 10 = 0")).withColumn("score", F.round("score", 6))


@query("similarity_pairs", f"WITH {E} SELECT a, b, round(score, 6) AS score FROM edges")
def similarity_pairs(spark, sf_dir):
    return retrieval.similar_vectors(_vectors(spark, sf_dir), 0.4).withColumn("score", F.round("score", 6))


@query("question_count", f"WITH {E} SELECT x.corpus, count(*) AS pairs FROM edges JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE x.corpus = y.corpus GROUP BY ALL")
def question_count(spark, sf_dir):
    return retrieval.question_count(_vectors(spark, sf_dir), 0.4, "corpus")


COMPONENTS = f"""WITH RECURSIVE {E}, both_ AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach(node, root) AS (SELECT id, id FROM v UNION SELECT both_.b, reach.root FROM reach JOIN both_ ON reach.node = both_.a),
 c AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


@query("components", f"{COMPONENTS} SELECT node, component, (dense_rank() OVER (ORDER BY component) - 1)::INTEGER AS cluster_id, count(*) OVER (PARTITION BY component) AS size FROM c")
def components(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return resolve.number_components(resolve.components(v.select(F.col("id").alias("node")), retrieval.similar_vectors(v, 0.4)))


@query("cluster_names", f"{COMPONENTS}, n AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c) SELECT component, list(p_name ORDER BY node) AS names FROM n JOIN part ON p_partkey = node WHERE size > 1 GROUP BY component")
def cluster_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    c = components(spark, sf_dir).where("size > 1").join(part, F.col("node") == part["p_partkey"])
    return c.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "p_name"))), lambda s: s["p_name"]).alias("names"))


def _relations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("seq"), F.initcap("p_name").alias("name"), F.concat(F.lit("The "), F.col("p_brand"), F.lit(" one holds "), F.repeat(F.lit("x"), (k % 7).cast("int"))).alias("description"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Defined by "), F.col("p_type"))).alias("definition"), F.col("p_type").alias("relation_type"), F.concat_ws(" | ", F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("usage_example"))


FOLD = """WITH r AS (SELECT p_partkey AS seq, p_name AS key, 'The ' || p_brand || ' one holds ' || repeat('x', (p_partkey % 7)::INTEGER) AS d, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Defined by ' || p_type END AS f, p_type, p_brand || ' | ' || p_name || ' | ' || p_type AS u FROM part),
 o AS (SELECT lower(key) AS k{0}, min(seq) AS seq, count(*) AS n_folded, arg_min(trim(d), length(trim(d)) * 1000000000 + seq) AS sd, arg_min(f, length(f) * 1000000000 + seq) FILTER (f <> '') AS sf FROM r GROUP BY ALL)
 SELECT o.seq, lower(r.key) AS name, CASE WHEN length(sd) < length(trim(r.d)) THEN sd ELSE r.d END AS description, CASE WHEN sf IS NOT NULL AND (r.f = '' OR length(sf) < length(r.f)) THEN sf ELSE r.f END AS definition, r.p_type AS relation_type, r.u AS usage_example, n_folded FROM o JOIN r ON o.seq = r.seq"""


@query("fold_by_class", FOLD.format(", p_type AS t"))
def fold_by_class(spark, sf_dir):
    return resolve.fold_duplicates(_relations(spark, sf_dir), True).withColumn("name", F.lower("name"))


@query("fold_global", FOLD.format(""))
def fold_global(spark, sf_dir):
    return resolve.fold_duplicates(_relations(spark, sf_dir), False).withColumn("name", F.lower("name"))


@query("leader_reduce", f"""{COMPONENTS}, n AS (SELECT c.*, count(*) OVER (PARTITION BY component) AS size FROM c), m AS (SELECT n.component, n.node AS seq, e, row_number() OVER (PARTITION BY component ORDER BY node) AS k FROM n JOIN v ON id = node WHERE size > 1),
 f(component, k, kept) AS (SELECT component, 1, [seq] FROM m WHERE k = 1 UNION ALL
  SELECT f.component, f.k + 1, CASE WHEN EXISTS (SELECT 1 FROM v l WHERE list_contains(f.kept, l.id) AND list_dot_product(l.e, m.e) >= 0.4) THEN f.kept ELSE list_append(f.kept, m.seq) END FROM f JOIN m ON m.component = f.component AND m.k = f.k + 1)
 SELECT component, unnest(arg_max(kept, k)) AS seq FROM f GROUP BY component""")
def leader_reduce(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    c = components(spark, sf_dir).where("size > 1").join(v, F.col("node") == v["id"]).select(F.col("component").alias("cluster_id"), F.col("node").alias("seq"), "vector")
    return resolve.reduce_clusters(c, lambda kept, new: {}, 0.4).select(F.col("cluster_id").alias("component"), "seq")


def _done(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_pdf"), F.lit(1).alias("paragraph_index"))


def _snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_pdf"), F.lit(1).alias("paragraph_index"), "lang", "source")


@query("checkpoint_pending", "SELECT doc_id AS source_pdf, 1 AS paragraph_index, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def checkpoint_pending(spark, sf_dir):
    return checkpoint.pending(_snippets(spark, sf_dir), _done(spark, sf_dir))


@query("checkpoint_resume", "SELECT doc_id AS source_pdf, 1 AS paragraph_index, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def checkpoint_resume(spark, sf_dir):
    return checkpoint.keep_finished(_snippets(spark, sf_dir), _done(spark, sf_dir))


def _manifests(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.lit("web").alias("corpus"), F.col("page_id").alias("source_file"), "html")
    now = p.where("source_file % 7 <> 0").select("corpus", "source_file", F.when(F.col("source_file") % 5 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")).cast("binary").alias("content"))
    return p, index.manifest(now), index.manifest(p.where("source_file % 11 <> 0").select("corpus", "source_file", F.col("html").cast("binary").alias("content")))


DIFF = """WITH n AS (SELECT page_id AS i, sha256(CASE WHEN page_id % 5 = 0 THEN html || '!' ELSE html END) AS h FROM pages WHERE page_id % 7 <> 0), b AS (SELECT page_id AS i, sha256(html) AS h FROM pages WHERE page_id % 11 <> 0),
 d AS (SELECT coalesce(n.i, b.i) AS source_file, CASE WHEN b.i IS NULL THEN 'new' WHEN n.i IS NULL THEN 'removed' WHEN n.h = b.h THEN 'same' ELSE 'changed' END AS change FROM n FULL OUTER JOIN b ON n.i = b.i)"""


@query("index_diff", DIFF + " SELECT 'web' AS corpus, source_file, change FROM d")
def index_diff(spark, sf_dir):
    _, now, before = _manifests(spark, sf_dir)
    return index.diff(now, before)


def _candidates(spark, sf_dir):
    """A relation of each document, made of its whole text; of each seven another breaks another rule."""
    d = table(spark, sf_dir, "documents")
    w = F.filter(F.split(tx.word_text(F.col("text")), r"\s+"), lambda x: F.length(x) > 3)
    k = F.col("doc_id") % 7
    return d.select(
        "doc_id", "text", F.when(k == 1, F.lit(None)).when(k == 2, F.lit("H2O")).otherwise(F.lit("part of")).alias("name"), F.col("text").alias("description"), F.when(k == 3, " ").otherwise(F.col("text")).alias("definition"),
        F.when(k == 4, "subsumption").otherwise(F.lit("Material  Relations")).alias("relation_type"),
        F.when(k == 5, "only two | parts").when(k == 6, F.lit("entity | part of | object")).otherwise(F.concat_ws(" | ", F.coalesce(F.get(w, 0), F.lit("zzzz")), F.lit("part of"), F.coalesce(F.get(w, 1), F.lit("zzzz")))).alias("usage_example"),
    )


CANDIDATES = rf"""c AS (SELECT doc_id, doc_id % 7 AS k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 3) AS w FROM documents),
 v AS (SELECT doc_id, CASE k WHEN 1 THEN NULL WHEN 2 THEN 'ho' ELSE 'part_of' END AS name, {_condensed("t", *validate.DESCRIPTION, True)} AS description, CASE k WHEN 3 THEN '' ELSE {_condensed("t", *validate.DEFINITION)} END AS definition,
  CASE k WHEN 4 THEN 'subsumption' ELSE 'Material Relations' END AS relation_type,
  CASE k WHEN 5 THEN 'only two | parts' WHEN 6 THEN 'entity | part of | object' ELSE coalesce(w[1], 'zzzz') || ' | part of | ' || coalesce(w[2], 'zzzz') END AS usage_example,
  CASE WHEN k = 1 THEN 'missing_field' WHEN t = '' OR k = 3 THEN 'empty_field' WHEN k = 0 THEN CASE WHEN len(w) < 2 THEN 'not_in_source' END WHEN k = 2 THEN 'predicate_differs' WHEN k = 4 THEN 'unknown_class' WHEN k = 5 THEN 'no_triple' ELSE 'placeholder' END AS reject_reason FROM c)"""


@query("relation_validate", f"WITH {CANDIDATES} SELECT * FROM v")
def relation_validate(spark, sf_dir):
    return validate.check_relations(_candidates(spark, sf_dir), source=F.col("text")).drop("text")


@query("run_counters", f"WITH {CANDIDATES} SELECT coalesce(reject_reason, 'accepted') AS reject_reason, count(*) AS n FROM v GROUP BY ALL")
def run_counters(spark, sf_dir):
    return validate.counters(validate.check_relations(_candidates(spark, sf_dir), source=F.col("text")))


@query("reasoning_strip", """SELECT conv_id, turn, trim(CASE turn % 5 WHEN 2 THEN role || ' ' || text WHEN 4 THEN role || ' ' || text ELSE text END, chr(32)||chr(10)) AS text FROM conversations""")
def reasoning_strip(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.col("turn") % 5
    a = F.when(k == 0, F.concat(F.lit("<think>"), "role", F.lit("</think> "), "text")).when(k == 1, F.concat("role", F.lit("</Reasoning>"), "text")).when(k == 2, F.concat("text", F.lit("<analysis>"), "role", F.lit(" "), "text"))
    a = a.when(k == 3, F.concat(F.lit("< Thinking >"), "role", F.lit("<\n/ thinking > "), "text")).otherwise(F.concat("text", F.lit("< / think >< reasoning\t>"), "role", F.lit(" "), "text"))
    return c.select("conv_id", "turn", tx.without_reasoning(a).alias("text"))


@query("fence_strip", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN trim(text, chr(32)||chr(10)) WHEN 1 THEN '```json ' || role ELSE text END AS text FROM conversations")
def fence_strip(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.col("turn") % 3
    fenced = F.when(k == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("```json "), "role", F.lit("```"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", tx.without_fence(fenced).alias("text"))


def _classes(spark):
    return spark.createDataFrame([(i, c, f"What {c} are", f"How {c} are told") for i, c in enumerate(validate.CLASSES)], "n int, name string, definition string, narrative string")


CLASS_ROWS = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(validate.CLASSES)) + ") t(n, name))"


@query("class_expansion", f"WITH {CLASS_ROWS} SELECT conv_id, turn, n AS class_no, name AS class_name, (SELECT string_agg('- ' || o.name, chr(10) ORDER BY o.n) FROM k o WHERE o.n <> k.n) AS others FROM conversations, k")
def class_expansion(spark, sf_dir):
    classes = _classes(spark)
    asked = prompts.class_requests(table(spark, sf_dir, "conversations").select("conv_id", "turn"), classes)
    others = prompts.other_classes(classes).select(F.col("n").alias("class_no"), "others")
    return asked.join(F.broadcast(others), "class_no")  # eleven rows


@query("prompt_render", r"""SELECT conv_id, turn, 'Find relations between things in the passage and name their kinds.' || chr(10) || CASE WHEN b.item_id IS NOT NULL THEN 'Background:' || chr(10) || 'test (1):' || chr(10) || '- ' || b.text || chr(10) ELSE '' END
  || CASE WHEN turn % 2 = 0 THEN 'Notes:' || chr(10) || role || chr(10) ELSE '' END || 'Passage:' || chr(10) || c.text || chr(10)
  || 'Answer with JSON: {"relations": [{"name", "description", "definition", "relation_type", "usage_example"}]}, an empty list if there are none.' AS prompt FROM conversations c LEFT JOIN benchmark b ON b.item_id = c.conv_id""")
def prompt_render(spark, sf_dir):
    c, b = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "b_text")
    both = c.join(b, c["conv_id"] == b["item_id"], "left")
    item = F.struct(F.col("b_text").alias("text"), F.lit("f").alias("source_file"), F.lit(1.0).alias("score"))
    found = F.create_map(F.lit("test"), F.when(F.col("b_text").isNotNull(), F.array(item)).otherwise(F.array().cast("array<struct<text:string,source_file:string,score:double>>")))
    return both.select("conv_id", "turn", prompts.extraction_prompt(found, F.when(F.col("turn") % 2 == 0, F.col("role")), F.col("text")).alias("prompt"))


def _stub_answer(prompt: str) -> str:
    """Relations made of the passage's words; a reading's labelled lines; all listed relations as one, with the first one's fields; that two mean the same."""
    if prompt.startswith("Do both"):
        return '{"same_meaning": true}'
    if prompt.startswith(("These ", "Group those ")):
        listed = prompt.split("\n\n")[1:-1]
        fields = dict(line.split(": ", 1) for line in listed[0].split("\n")[1:])
        return json.dumps({"groups": [{"members": list(range(1, len(listed) + 1)), **{f: fields[label] for label, f in prompts.FIELDS}}]})
    passage = prompt.rsplit("Passage:\n", 1)[-1].split("\nAnswer", 1)[0]
    words = re.findall("[a-z]{4,}", passage.lower()) or ["none"]
    if prompt.startswith("Read"):
        return f"Verbs: {words[0]}\nReading: {passage[:80]}\nLinks: {words[0]} | is | {words[-1]}"
    row = '{{"name": "{0} of", "description": "A {0} belongs to a {1}.", "definition": "What a {1} has of {0}.", "relation_type": "Subsumption", "usage_example": "{0} | {0} of | {1}"}}'
    return "<think>so</think>```json\n{\"relations\": [" + row.format(words[0], words[-1]) + "]}\n```"


def _stub() -> model.Stub:
    return model.Stub(_stub_answer)


#: Answers of ten shapes: what they hold tells which list is taken for the relations.
@query("json_relations", """SELECT conv_id, turn, CASE turn % 10 WHEN 2 THEN 'empty' WHEN 3 THEN 'unreadable' WHEN 5 THEN 'empty' WHEN 7 THEN 'unreadable' WHEN 9 THEN 'unreadable' ELSE 'read' END AS status,
 CASE turn % 10 WHEN 0 THEN [text] WHEN 1 THEN [text] WHEN 4 THEN [text, NULL] WHEN 6 THEN [role] WHEN 8 THEN [text] ELSE [] END::VARCHAR[] AS descriptions FROM conversations""")
def json_relations(spark, sf_dir):
    out = answers.parse_answers(_answers(spark, sf_dir))
    return out.select("conv_id", "turn", F.col("parsed.status").alias("status"), F.transform("parsed.relations", lambda r: r["description"]).alias("descriptions"))


@query("strict_answers", """SELECT (turn % 10)::INTEGER AS shape, turn % 10 IN (0, 2, 4, 5) AS strict, count(*) AS n, sum(CASE turn % 10 WHEN 4 THEN 2 ELSE (turn % 10 IN (0, 1, 6, 8))::INTEGER END)::BIGINT AS relations FROM conversations GROUP BY ALL""")
def strict_answers(spark, sf_dir):
    """Answers by shape and by whether they were read in the JVM, with their relations."""
    out = answers.parse_answers(_answers(spark, sf_dir), strict_col="strict")
    return out.groupBy((F.col("turn") % 10).cast("int").alias("shape"), "strict").agg(F.count("*").alias("n"), F.sum(F.size("parsed.relations")).cast("long").alias("relations"))


def _answers(spark, sf_dir):
    """Turns of conversations with answers of ten shapes."""
    c, k = table(spark, sf_dir, "conversations"), F.col("turn") % 10
    whole = F.to_json(F.struct(F.lit("part of").alias("name"), F.col("text").alias("description"), F.col("role").alias("definition"), F.lit("x").alias("relation_type"), F.lit("u").alias("usage_example")))
    part = F.to_json(F.struct(F.lit("part of").alias("name"), F.col("role").alias("description")))
    shapes = [
        F.concat(F.lit('{"relations": ['), whole, F.lit("]}")),
        F.concat(F.lit("Here: "), whole, F.lit(" and then {\"a\": 1} as asked")),
        F.lit('{"relations": []}'),
        F.col("text"),
        F.concat(F.lit('["x", '), whole, F.lit(', {"name": "n"}]')),
        F.concat(F.lit('{"name": "", "relations": [], "note": '), F.to_json(F.struct("text")), F.lit("}")),
        # Two fields are no relation: the only list of the object is taken.
        F.concat(F.lit('{"name": "n", "description": "d", "items": ['), part, F.lit("]}")),
        F.lit("null"),
        F.concat(F.lit("[1, 2] or ```json "), whole, F.lit("```")),
        F.lit('{"relations": null, "name": "n"}'),
    ]
    text = F.coalesce(*[F.when(k == i, s) for i, s in enumerate(shapes)])
    return c.withColumn("answer", text)


@query("knowledge_run")
def knowledge_run(spark, sf_dir):
    """Extraction, by the default options, and consolidation over all documents, with stand-ins for model and encoder."""
    d = table(spark, sf_dir, "documents")
    s = bl.snippets(d.select(F.col("doc_id").alias("doc"), F.lit(1).alias("block_no"), F.lit(1).alias("page"), "text")).withColumnRenamed("doc", "source_pdf")
    found = knowledge.extract(s, _classes(spark), _stub, Options(), _passages(spark, sf_dir))
    # Written, since rows are read more than once and a condition on the reason would be pushed below the checks.
    found = written(found.select("source_pdf", "paragraph_index", "class_no", "place", *validate.REQUIRED, "reject_reason"))
    good = found.where(F.col("reject_reason").isNull()).withColumn("source_pdf", F.col("source_pdf").cast("long"))
    # The order of arrival as one number, without a sort of all rows: at most 2**20 snippets of a document, 16 classes, 256 relations of an answer.
    seq = F.shiftleft("source_pdf", 32) + F.shiftleft(F.col("paragraph_index").cast("long"), 12) + F.col("class_no") * 256 + F.col("place")
    return knowledge.consolidate_by_model(good.select(seq.alias("seq"), *validate.REQUIRED, "source_pdf"), _stub, Options())


def _passages(spark, sf_dir):
    """An index of two corpora: benchmark items and turns of conversations."""
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").cast("string").alias("source_file"), F.lit(0).alias("chunk_index"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("corpus"), F.col("conv_id").cast("string").alias("source_file"), F.col("turn").cast("int").alias("chunk_index"), "text")
    return written(retrieval.encode(b.unionByName(c), "text"))


from folioloom import catalogue_parts, catalogue_runs  # noqa: E402, F401  they add their queries to these
