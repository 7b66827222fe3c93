import random
import re
from collections import defaultdict

from folioloom.llm import mixing


def fill(sizes, weights=(5, 2, 1)):
    """Targets by repeated sharing; sizes in the order of their sources."""
    w = [weights[i % 3] for i in range(len(sizes))]
    total, full = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in full)
        free = sum(w[i] for i in range(len(w)) if i not in full)
        share = [3 * sizes[i] if i in full else left * w[i] / free for i in range(len(w))]
        over = {i for i in range(len(w)) if i not in full and share[i] > 3 * sizes[i]}
        if not over:
            return share
        full |= over
        if len(full) == len(w):
            return [3 * s for s in sizes]


def check(df, near):
    rows = mixing.mix(df).collect()
    size = defaultdict(int)
    for r in df.collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, fill([size[s] for s in order])))
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert len(rows) == df.count()
    assert all(abs(taken[s] - target[s]) <= near(s) for s in target)
    return rows


def test_targets_are_met(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 300), f"s{min(rng.randrange(12), 5)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = check(df, lambda s: 300)
    two = check(df.repartition(13), lambda s: 300)
    assert sorted((r.doc_id, r.copies) for r in one) == sorted((r.doc_id, r.copies) for r in two)


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(i, "w " * 10, "a") for i in range(3)] + [(10 + i, "w " * 10, "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = check(df, lambda s: 10)
    assert all(r.copies == 3 for r in got if r.source == "a")


def test_nulls_repeats_and_odd_columns(nasty, nothing):
    check(nasty, lambda s: 20000)
    assert mixing.mix(nothing).collect() == [] and mixing.apply_mix(nothing).collect() == []
    out = mixing.apply_mix(nasty)
    assert out.columns == [*nasty.columns, "mix_copy", "mix_size", "mix_target"]
    assert out.count() == sum(r.copies for r in mixing.mix(nasty).collect())
    assert mixing.apply_mix(out).columns == out.columns


def test_pivot_keeps_the_sum_and_settles():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 30)
        sizes, p = [rng.randint(1, 50) for _ in range(n)], [rng.random() for _ in range(n)]
        q = mixing.pivot(list(range(n)), sizes, p, 5, last=False)
        assert sum(0 < x < 1 for x in q) <= 1
        assert abs(sum(s * x for s, x in zip(sizes, q)) - sum(s * x for s, x in zip(sizes, p))) < 1e-6
        assert all(x in (0.0, 1.0) for x in mixing.pivot(list(range(n)), sizes, p, 5, last=True))


def test_expected_copies_are_the_probabilities():
    n, runs = 6, 4000
    sizes, p = [3, 9, 4, 7, 5, 8], [0.2, 0.5, 0.7, 0.4, 0.6, 0.3]
    mean = [0.0] * n
    for seed in range(runs):
        for i, x in enumerate(mixing.pivot(list(range(n)), sizes, p, seed, last=True)):
            mean[i] += x / runs
    assert all(abs(m - q) < 0.04 for m, q in zip(mean, p))


def test_documents_without_an_id_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    seen = []
    level = mixing._level

    def counted(rows, seed, last):
        seen.append(max(r["count"] for r in rows.groupBy("place", "chunk").count().collect()))
        return level(rows, seed, last)

    monkeypatch.setattr(mixing, "_level", counted)
    df = spark.createDataFrame([(None, f"a b c {i}", "s") for i in range(400)] + [(None, f"x {i}", "t") for i in range(200)], "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == 600 and seen[0] < 40
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))


def test_ten_thousand_repeats_of_a_row_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 1000)
    held = []
    level = mixing._level
    monkeypatch.setattr(mixing, "_level", lambda rows, *a, **k: held.append(rows.groupBy("place", "chunk").count().agg({"count": "max"}).head()[0]) or level(rows, *a, **k))
    rows = [(5, "a b c d", "s0")] * 10_000 + [(i, "a b c", f"s{i % 3}") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and max(held) < 4 * mixing.CHUNK
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    mixed = mixing.apply_mix(df)
    assert mixed.count() == sum(r.copies for r in got)
