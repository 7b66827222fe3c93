import math
import random
import re
from collections import Counter

import numpy as np

from folioloom.llm import wand

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) for w in WORD.findall(text or "")]


def brute(docs, items, k=20):
    found = [(d, terms(t)) for d, t in docs]
    big_n, big_l = sum(1 for _, w in found if w), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, w in found:
            if not w:
                continue
            m, tf, score = 75 + 25 * len(w) * big_n // big_l, Counter(w), 0
            for t in terms(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def result(df):
    return sorted(repr((r.item_id, r.rank, r.doc_id, r.score)) for r in df.collect())


ITEMS = [(1, "w1 w2 the w3 w1"), (2, "é w9"), (2, "w7"), (3, None), (4, ""), (5, "nowhere at all"), (None, "w4 ONE"), (1, "w1 w2 the w3 w1"), (6, "x a b c d"), (7, "w1, w2.W3;w4 w5 w6 w7 w8 w9 w10 w11 w12")]


def test_against_brute_force_in_any_shards_and_blocks(spark, nasty):
    docs = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, rank int")
    for k, shard_docs, shard_postings, window, block_terms in ((20, 8192, 10**6, 1024, 10**6), (3, 4, 10**6, 2, 10**6), (1, 100, 30, 5, 8)):
        got = wand.search(nasty, items, k, shard_docs=shard_docs, shard_postings=shard_postings, window=window, block_terms=block_terms)
        assert result(got) == brute(docs, ITEMS, k)


def test_many_ties_go_to_the_smaller_id(spark):
    docs = [(i, "common rare" if i % 50 == 7 else "common other words") for i in range(3000)] + [(None, "common rare")] * 3 + [(57, "common rare")] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    items = [(1, "rare"), (2, "common rare"), (3, "other")]
    got = wand.search(df, spark.createDataFrame(items, "item_id long, text string"), shard_docs=100, window=16)
    assert result(got) == brute(docs, items)


def test_documents_that_cannot_win_are_skipped():
    rng = random.Random(5)
    n = 20_000
    rare, common = np.sort(np.array(rng.sample(range(n), 60))), np.arange(n)
    postings = [(1000, rare, np.full(60, 900)), (50, common, np.array([rng.randint(1, 50) for _ in range(n)]))]
    ids, null = np.arange(n), np.zeros(n, bool)
    heap = wand.Heap(10)
    scored = wand.wand(postings, ids, null, heap, window=256)
    every = np.zeros(n, np.int64)
    for _, at, impact in postings:
        every[at] += impact
    order = np.lexsort((ids, -every))[:10]
    assert heap.doc.tolist() == order.tolist() and heap.score.tolist() == every[order].tolist()
    assert scored < n / 5  # all up to the tenth rare one, then rare ones


def test_empty_tables(spark, nasty, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert wand.search(nothing, items).collect() == []
    assert wand.search(nasty, items.limit(0)).collect() == []
