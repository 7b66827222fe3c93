import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioloom.llm import backoff


def brute(rows, order):
    def grams(w):
        return Counter(tuple(w[i - m : i + 1]) for i in range(len(w)) for m in range(order) if i >= m)

    total = Counter()
    for _, t in rows:
        total += grams((t or "").encode().split())
    n = sum(len((t or "").encode().split()) for _, t in rows)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        own = grams(w)
        others, log, short = n - len(w), 0.0, 0

        def f(g):
            return total[g] - own[g]

        for i in range(len(w)):
            s, backed = (f((w[i],)) / others if f((w[i],)) else 1 / (others + 1)), False
            for m in range(1, order):
                if i >= m:
                    g = tuple(w[i - m : i + 1])
                    s, backed = (f(g) / f(g[:-1]), False) if f(g) else (0.4 * s, True)
            log += math.log(s)
            short += backed
        out.append((str(d), len(w), short, round(log, 6)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(nasty, order):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_words, r.n_backoff, round(r.log_score, 6)) for r in backoff.scores(nasty, order).collect())
    want = brute(rows, order)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-5 * max(1, abs(w[3])) for g, w in zip(got, want))


def test_empty_table_and_no_words(spark, nothing):
    assert backoff.scores(nothing).collect() == []
    r = backoff.scores(spark.createDataFrame([(1, "")], "doc_id long, text string")).head()
    assert (r.n_words, r.log_score, r.mean_log_score) == (0, 0.0, None)


def test_passes_and_repeated_rows(spark):
    rows = [(1, "a b c a b"), (1, "a b c a b"), (None, "a b d"), (2, None), (3, "c a b d d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1))
    want = brute(rows, 3)
    for passes in (1, 4):
        got = sorted((str(r.doc_id), r.n_words, r.n_backoff, round(r.log_score, 6)) for r in backoff.scores(df, 3, passes=passes).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, want))


def test_shuffled_rows(spark):
    """N-grams are shuffled once, by block: not exploded for each document, once to be counted and once to be joined."""
    rng = random.Random(5)
    texts = [" ".join(f"word{int(rng.paretovariate(0.6)) % 3000}" for _ in range(400)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled() -> int:
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    df.count()
    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        assert backoff.scores(df).count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled() - before < 200 * len(texts)


def test_many_blocks_and_a_row_many_times(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(7, "a b c q")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_backoff, round(r.log_score, 6)) for r in backoff.scores(df, 3, passes=3, block_bytes=64).collect())
    want = brute(rows, 3)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-5 * max(1, abs(w[3])) for g, w in zip(got, want))
