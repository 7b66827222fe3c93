"""Named queries of what a run keeps and decides over several steps: stored indexes, streams, counters, frontiers, leaders in rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom import catalogue_parts as parts
from folioloom.catalogue import COMPONENTS, _vectors, components, query, table
from folioloom.operators import blocks as bl
from folioloom.operators import index, names, resolve, retrieval
from folioloom.plans import answers, model
from folioloom.streaming.snippets import extract_stream, stream_snippets


@query("index_stored", r"""WITH f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE 'y' END AS corpus, 'd' || doc_id AS source_file, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE doc_id % 7 <> 0),
 p AS (SELECT corpus, source_file, unnest(string_split(t, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS n FROM f), c AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM p)
 SELECT corpus, source_file, (row_number() OVER (PARTITION BY corpus, source_file ORDER BY n) - 1)::INTEGER AS chunk_index, text, 5 AS size FROM c WHERE length(text) >= 80""")
def index_stored(spark, sf_dir):
    """An index that is refreshed three times: made, brought to files of which some changed, are gone or new, and left as it is."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.when(d % 3 == 0, "x").otherwise("y").alias("corpus"), F.concat(F.lit("d"), d.cast("string")).alias("source_file"), d, F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    files = docs.where(d % 7 != 0)
    before = docs.where(d % 11 != 0).withColumn("content", F.when(d % 5 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    kept = index.Stored(spark, parts._fresh(spark), "letters", parts.letters, by_sentence=False)
    for now in (before, files, files):
        kept.refresh(now)
    return kept.read().select("corpus", "source_file", "chunk_index", "text", F.size("vector").alias("size"))


@query("streamed_snippets", "SELECT doc_id AS source_pdf, 1 AS paragraph_index, length(text)::BIGINT AS n FROM documents")
def streamed_snippets(spark, sf_dir):
    """Snippets that arrive in files, some of them twice, through a stream that answers each once."""
    at = parts._fresh(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_pdf"), F.lit(1).alias("paragraph_index"), "text")
    files = max(3, d.rdd.getNumPartitions())  # more of them, the more there is to read, in two batches
    d.repartition(files, "source_pdf").write.parquet(f"{at}/in")
    schema = "source_pdf long, paragraph_index int, text string"
    for _ in range(2):  # the second time all of them arrive again
        work = lambda batch: batch.select("source_pdf", "paragraph_index", F.length("text").cast("long").alias("n"))
        extract_stream(stream_snippets(spark, f"{at}/in", schema, -(-2 * files // 3)), work, f"{at}/out", f"{at}/log", f"{at}/state").awaitTermination()
        d.write.mode("append").parquet(f"{at}/in")
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("observed_counts", """SELECT count(*) AS requests, 0::BIGINT AS truncated, 0::BIGINT AS failed, count(*) FILTER (turn % 4 = 3) AS unreadable FROM conversations""")
def observed_counts(spark, sf_dir):
    """What asking a model for all turns comes to, counted as the answers pass."""
    c = table(spark, sf_dir, "conversations").select("turn", F.concat(F.when(F.col("turn") % 4 == 3, "no json {").otherwise('{"relations": []} '), F.lit(" ")).alias("prompt"))
    counters = model.Counters()
    asked = counters.watch(model.ask_all(c, lambda: model.Stub(lambda p: p)), **model.request_counts())
    read = counters.watch(answers.parse_answers(asked), unreadable=F.count_if(F.col("parsed.status") == "unreadable"))
    read.write.format("noop").mode("overwrite").save()
    told = counters.totals()  # four numbers
    return spark.createDataFrame([tuple(told[k] for k in ("requests", "truncated", "failed", "unreadable"))], "requests long, truncated long, failed long, unreadable long")


KEPT = f"""{COMPONENTS}, n AS (SELECT c.*, count(*) OVER (PARTITION BY component) AS size FROM c), m AS (SELECT n.component, n.node AS seq, e, row_number() OVER (PARTITION BY component ORDER BY node) AS k FROM n JOIN v ON id = node WHERE size > 1),
 f(component, k, kept) AS (SELECT component, 1, [seq] FROM m WHERE k = 1 UNION ALL
  SELECT f.component, f.k + 1, CASE WHEN EXISTS (SELECT 1 FROM v l WHERE list_contains(f.kept, l.id) AND list_dot_product(l.e, m.e) >= 0.4) THEN f.kept ELSE list_append(f.kept, m.seq) END FROM f JOIN m ON m.component = f.component AND m.k = f.k + 1),
 kept AS (SELECT component, unnest(arg_max(kept, k)) AS seq FROM f GROUP BY component)"""


@query("frontier_reduce", f"{KEPT} SELECT component, seq FROM kept")
def frontier_reduce(spark, sf_dir):
    """Clusters of similar vectors, all of them reduced by frontiers."""
    v = _vectors(spark, sf_dir)
    c = components(spark, sf_dir).where("size > 1").join(v, F.col("node") == v["id"]).select(F.col("component").alias("cluster_id"), F.col("node").alias("seq"), "vector")
    return resolve.reduce_clusters(c, lambda kept, new: {}, 0.4, group=0).select(F.col("cluster_id").alias("component"), "seq")


@query("leader_rounds", f"{KEPT} SELECT m.seq, kept.seq IS NOT NULL AS leads FROM m LEFT JOIN kept ON kept.seq = m.seq")
def leader_rounds(spark, sf_dir):
    """Which vectors lead, in the order of their ids, decided in rounds to the end."""
    pairs = retrieval.similar_vectors(_vectors(spark, sf_dir), 0.4).select(F.col("a").alias("a_seq"), F.col("b").alias("b_seq"))
    return names.first_leaders(pairs, finish=0)


@query("text_snippets", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
 t AS (SELECT doc_id, n, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM l)
 SELECT doc_id AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INTEGER AS paragraph_index, text FROM t WHERE length(text) >= 80""")
def text_snippets(spark, sf_dir):
    """Snippets of paragraphs of at least 80 characters, each line a paragraph of its own."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    each = lines.select("doc", (F.col("n") + 1).alias("block_no"), F.lit(1).alias("page"), F.trim(F.regexp_replace("line", r"[ \t\n]+", " ")).alias("text"))
    return bl.snippets(bl.paragraphs(each.limit(0), each)).select("doc", "paragraph_index", "text")
