import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from folioloom.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + m]) for m in range(1, n + 1) for i in range(len(words) - m + 1)], len(words)


def brute(rows, target, n=1, buckets=10000, percent=10, least=20):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, n)[0])

    s, t = count([x for _, x in rows]), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (big_s + buckets) / ((s[k] + 1) * (big_t + buckets)))) for k in range(buckets)}
    out = []
    for d, x in rows:
        f, words = features(x, n)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0, -o[2], -o[1]))
    for rank, o in enumerate(able[: percent * len(able) // 100], 1):
        o[4] = rank
    return sorted(map(repr, (tuple(o[:5]) for o in out)))


def result(df):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in df.collect())


@pytest.mark.parametrize("n,percent", [(1, 10), (2, 60), (3, 100)])
def test_against_brute_force(spark, nasty, n, percent):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    target = ["w1 w2 w3 The w4", "é", None, "", "w1 w2"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    assert result(importance.resample(nasty, t, n=n, percent=percent, buckets=500)) == brute(rows, target, n, 500, percent)


def test_ring_carries_states_on():
    words = [b"a", b"bc", b"d", "é".encode(), b"a"]
    for n in (1, 2, 3, 9):
        want = Counter(zlib.crc32(b" ".join(words[i : i + m])) for m in range(1, n + 1) for i in range(len(words) - m + 1))
        assert Counter(importance.ring(words, n)) == want


def test_ranks_over_many_ranges_and_ties(spark):
    rows = [(i // 4, "word " * 25) for i in range(400)] + [(None, "word " * 25)] * 3 + [(900 + i, "few words") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("word",)], "text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = importance.resample(df, target, percent=50)
            assert result(got) == brute(rows, ["word"], percent=50)
            assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 202))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_tables(spark, nasty, nothing):
    assert importance.resample(nothing, nasty).collect() == []
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    assert result(importance.resample(nasty, nothing)) == brute(rows, [])
