"""Each stage of the pipeline, on the documents of the tables and on nasty ones, against a plain version."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioloom.llm import mixing, toxicity
from folioloom.llm._common import WORD

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def plain_toxicity(spark, rows, docs):
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    out = []
    for r in rows:
        z = sum(model.weights[at] * np.log2(1 + n) for at, n in zip(*toxicity.features(r["text"] or "")[:2]))
        upto = [1 / (1 + np.exp(-(t - z))) for t in model.thresholds]
        if sum(1 - p for p in upto) < toxicity.REJECT:  # the expected grade: the sum of the chances to be above each threshold
            out.append(r)
    return out


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain_line_dedup(spark, rows, docs):
    holders = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key_of(line)) >= 40:
                holders.setdefault(key_of(line), set()).add(r["doc_id"])
    top = {k: max(v, key=lambda d: (d is not None, d)) for k, v in holders.items() if len(v) >= 5}
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if key_of(x) not in top or top[key_of(x)] == r["doc_id"]]
        if r["text"] is not None and len(kept) < len(lines):
            r = r | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))}
        out.append(r)
    return out


def plain_near_dedup(spark, rows, docs):
    """Ids and texts of which one row is to be left for each group."""
    texts = sorted({tuple((r["text"] or "").encode().lower().split()) for r in rows})
    sets = [set(zip(*(t[j:] for j in range(5)))) if len(t) >= 5 else {t} for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    out = {}
    for r in rows:
        g = group[tuple((r["text"] or "").encode().lower().split())]
        if g not in out or r["doc_id"] is not None and (out[g]["doc_id"] is None or r["doc_id"] < out[g]["doc_id"]):
            out[g] = r
    return list(out.values())


def words_of(text):
    import regex

    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def plain_decontamination(spark, rows, docs):
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(w := words_of(r.text)) >= 5]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted = [shingles(w) for w in items]
    return [r for r in rows if not any(len(q & s) >= 0.8 * len(q) - 1e-9 for q in wanted for s in [shingles(words_of(r["text"]))])]


def plain_copies(docs):
    """Copies of each row, (doc_id, source, size) by the tree of chunks walked in one place; rows' hashes come from Spark."""
    h = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"), F.lit(7))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = [r.asDict() for r in docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), h.alias("h"), F.xxhash64(F.coalesce("source", F.lit("\x00null"))).alias("place")).collect()]
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(), sum(sizes.values())
    while True:
        left, free = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / free for s in order}
        if not (over := {s for s in order if s not in full and target[s] > 3 * sizes[s]}):
            break
        full |= over
        if len(full) == len(order):
            target = {s: 3 * sizes[s] for s in order}
            break
    chunks = max(1, -(-len(rows) // mixing.CHUNK))
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]] if r["size"] and sizes[r["source"]] else 0.0
        r["whole"], r["p"], r["chunk"] = int(rate), rate - int(rate), r["h"] % chunks
    while True:
        met = {}
        for r in rows:
            if 0 < r["p"] < 1:
                met.setdefault((r["place"], r["chunk"]), []).append(r)
        for group in met.values():
            group.sort(key=lambda r: (-r["size"], r["h"], r["p"]))
            for r, p in zip(group, mixing.pivot([r["h"] for r in group], [r["size"] for r in group], [r["p"] for r in group], 7, chunks == 1)):
                r["p"] = p
        if chunks == 1:
            break
        chunks = -(-chunks // mixing.FAN_IN)
        for r in rows:
            r["chunk"] %= chunks
    return Counter((r["doc_id"], r["source"], r["size"], r["whole"] + int(r["p"])) for r in rows)


PLAIN = {"toxicity": plain_toxicity, "line_dedup": plain_line_dedup, "simhash_near_dedup": plain_near_dedup, "decontamination": plain_decontamination}


@pytest.mark.parametrize("source", ["tables", "nasty"])
def test_each_stage_against_a_plain_one(spark, nasty, source, monkeypatch):
    docs = nasty if source == "nasty" else spark.read.parquet(f"{SF}/documents.parquet")
    told = lambda rows: Counter(repr(sorted((k, v) for k, v in r.items())) for r in rows)
    for name, plain in PLAIN.items():
        rows = [r.asDict() for r in docs.collect()]
        got = [r.asDict() for r in STAGES[name](spark, docs, SF).collect()]
        want = plain(spark, rows, docs)
        if name == "simhash_near_dedup":  # of rows of one id and group, any
            ids = lambda some: Counter(r["doc_id"] for r in some)
            assert ids(got) == ids(want) and set(told(got)) <= set(told(rows))
        else:
            assert told(got) == told(want), name
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in got], docs.schema)
    monkeypatch.setattr(mixing, "CHUNK", 16)
    columns = docs.columns
    out = STAGES["mixing"](spark, docs, SF)
    assert out.columns == [*columns, "mix_copy", "mix_size", "mix_target"]
    n = Counter()
    for r in out.collect():
        n[r.doc_id, r.source, r.mix_size] += 1
    want = Counter()
    for (d, s, size, copies), k in plain_copies(docs).items():
        want[d, s, size] += copies * k
    assert n == Counter({k: v for k, v in want.items() if v})


def test_each_stage_of_nothing(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).collect() == []


def test_an_earlier_mix_is_replaced(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9, 9, 9.0)], "doc_id long, text string, source string, mix_copy int, mix_size int, mix_target double")
    assert [tuple(r) for r in mixing.apply_mix(df).collect()] == [(1, "a b", "s", 1, 2, 2.0)]
