"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import backoff, decontaminate, html, importance, lines, mixing, onebit, secrets, simhash, substrings, suffixes, toxicity, wand
from folioloom.llm._common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


@query(
    "op1_substring_dedup",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
     p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w WHERE len(w) >= 20),
     f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY md5(array_to_string(w[p:p+19], ' ')) ORDER BY doc_id, p) > 1 AS later FROM p),
     c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM f WHERE later),
     t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
     r AS (SELECT t.doc_id, t.i, word, c.i IS NOT NULL AS gone FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = t.i)
SELECT w.doc_id, count(word) AS n_words, count(word) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query(
    "op3_decontamination",
    r"""WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
     ic AS (SELECT w, least(len(w), 5) AS k, min(item_id) AS item_id, count(*) AS n_items FROM iw WHERE len(w) >= 1 GROUP BY w),
     s AS (SELECT DISTINCT item_id, n_items, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM ic),
     q AS (SELECT item_id, n_items, count(*) AS q FROM s GROUP BY ALL),
     dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
     ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM dw JOIN (SELECT DISTINCT k FROM ic) ON len(w) >= k),
     h AS (SELECT doc_id, item_id, count(*) AS n FROM ds JOIN s USING (k, s) GROUP BY ALL)
SELECT doc_id, h.item_id, n_items, q AS n_shingles, n / q AS containment FROM h JOIN q USING (item_id) WHERE n / q >= 0.8 - 1e-9""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op4_stupid_backoff",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents WHERE text IS NOT NULL),
     t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
     b AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM t),
     u AS (SELECT w, count(*) AS f FROM t GROUP BY w), ud AS (SELECT doc_id, w, count(*) AS f FROM t GROUP BY ALL),
     g AS (SELECT p, w, count(*) AS f FROM b WHERE p IS NOT NULL GROUP BY ALL), gd AS (SELECT doc_id, p, w, count(*) AS f FROM b WHERE p IS NOT NULL GROUP BY ALL),
     n AS (SELECT doc_id, count(*) AS n, (SELECT count(*) FROM t) - count(*) AS others FROM t GROUP BY doc_id),
     s AS (SELECT b.doc_id, b.i, b.p AS p, others, u.f - ud.f AS fw, up.f - pd.f AS fp, coalesce(g.f - gd.f, 0) AS fg
           FROM b JOIN n USING (doc_id) JOIN u ON u.w = b.w JOIN ud ON ud.w = b.w AND ud.doc_id = b.doc_id
           LEFT JOIN u up ON up.w = b.p LEFT JOIN ud pd ON pd.w = b.p AND pd.doc_id = b.doc_id
           LEFT JOIN g ON g.p = b.p AND g.w = b.w LEFT JOIN gd ON gd.doc_id = b.doc_id AND gd.p = b.p AND gd.w = b.w),
     r AS (SELECT doc_id, p IS NOT NULL AND fg = 0 AS short, ln(CASE WHEN fg > 0 THEN fg / fp ELSE (CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) * (CASE WHEN fw > 0 THEN fw / greatest(others, 1) ELSE 1 / (others + 1.0::DOUBLE) END) END) AS s FROM s),
     d AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE short) AS n_backoff, sum(s) AS log_score FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(log_score, 0), 4) AS log_score, round(log_score / n_words, 6) AS mean_log_score FROM documents LEFT JOIN d USING (doc_id)""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff.scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


@query(
    "op7_line_dedup",
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
     k AS (SELECT doc_id, n, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     hot AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     j AS (SELECT k.doc_id, k.n, k.line, hot.top IS NOT NULL AND hot.top <> k.doc_id AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_digest(table(spark, sf_dir, "documents"))


@query(
    "op8_one_bit_search",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return onebit.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


#: Words of an op11 or op12 text, in SQL: A-Z in lower case; letters, digits and what is beyond ASCII.
_LOWER_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"


@query(
    "op11_importance_resampling",
    f"""WITH dw AS (SELECT doc_id, coalesce({_LOWER_WORDS}, []) AS w FROM documents), bw AS (SELECT {_LOWER_WORDS} AS w FROM benchmark),
     table_ AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
     v AS (SELECT DISTINCT unnest(w) AS x FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
     utf AS (SELECT x, list_transform(range(1, octet_length(encode(x)) + 1), lambda i: ('0x' || substr(hex(encode(x)), 2 * i - 1, 2))::BIGINT) AS b FROM v),
     c AS (SELECT x, xor(list_reduce(list_concat([4294967295], b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM utf, table_),
     f AS (SELECT doc_id, k FROM (SELECT doc_id, unnest(w) AS x FROM dw) JOIN c USING (x)), g AS (SELECT k FROM (SELECT unnest(w) AS x FROM bw) JOIN c USING (x)),
     s AS (SELECT k, count(*) AS s FROM f GROUP BY k), t AS (SELECT k, count(*) AS t FROM g GROUP BY k),
     gain AS (SELECT k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (k)),
     d AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN gain USING (k) GROUP BY doc_id),
     r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM dw LEFT JOIN d USING (doc_id)),
     k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM k) THEN rank END AS rank FROM r LEFT JOIN k USING (doc_id)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op12_ranked_search",
    f"""WITH w AS (SELECT doc_id, unnest({_LOWER_WORDS}) AS t FROM documents), i AS (SELECT item_id, unnest({_LOWER_WORDS}) AS t FROM benchmark),
     s AS (SELECT count(DISTINCT doc_id) AS big_n, count(*) AS big_l FROM w),
     m AS (SELECT doc_id, 75 + (25 * count(*) * any_value(big_n)) // any_value(big_l) AS m FROM w, s GROUP BY doc_id),
     tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
     q AS (SELECT item_id, t, count(*) AS c FROM i GROUP BY ALL),
     x AS (SELECT item_id, t, c * floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (t), s),
     r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM x JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL),
     k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_suffix_array_dedup",
    """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     p AS (SELECT doc_id, unnest(range(0, octet_length(encode(h)) // 2 - 399)) AS p, unnest(list_transform(range(0, octet_length(encode(h)) // 2 - 399), lambda i: md5(substr(h, 2 * i + 1, 800)))) AS k FROM d WHERE octet_length(encode(h)) >= 800),
     m AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
     s AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM p JOIN m USING (k)),
     r AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
     g AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b FROM r GROUP BY ALL),
     b AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(struct_pack(a := a, b := b) ORDER BY a) AS g FROM g GROUP BY doc_id)
SELECT doc_id, octet_length(encode(h)) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN g IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(g) + 2), lambda i: substr(h, CASE WHEN i = 1 THEN 1 ELSE 2 * g[i - 1].b + 1 END, CASE WHEN i > len(g) THEN 1000000000 ELSE 2 * (g[i].a - CASE WHEN i = 1 THEN 0 ELSE g[i - 1].b END) END)), '') END)) AS kept_sha256 FROM d LEFT JOIN b USING (doc_id)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
