import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from folioloom.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def groups(fps, linked):
    """The least label each item reaches."""
    label = {f: f for f in fps}
    done = False
    while not done:
        done = True
        for a in fps:
            for b in fps:
                if linked(a, b) and label[b] < label[a]:
                    label[a], done = label[b], False
    return label


def test_components_against_brute_force(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    fp = [slow_fingerprint(t) for _, t in rows]
    root = groups(sorted(set(fp)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, _), f in zip(rows, fp):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    want = Counter((d, f, least.get(root[f])) for (d, _), f in zip(rows, fp))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(nasty).collect())
    assert got == want


def test_links_of_close_fingerprints(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(12)} | set(seeds)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    root = groups(sorted(s for (s,) in signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {r.node: r.root for r in got} == {n: r for n, r in root.items() if Counter(root.values())[r] > 1}


def test_long_lists_give_the_links_of_short_ones():
    rng = np.random.default_rng(1)
    mask = simhash._masks(6)[3]
    free = [i for i in range(64) if not mask >> i & 1]
    fps = np.unique(np.array([sum(1 << f for f, b in zip(free, bits) if b) for bits in rng.random((500, 16)) < 0.3], np.uint64))
    assert len(fps) > simhash.SMALL_LIST
    i, j = np.triu_indices(len(fps), 1)
    want = {(a, b) for a, b in zip(i, j) if int(fps[a] ^ fps[b]).bit_count() <= 2}
    assert {tuple(sorted((int(a), int(b)))) for x, y in simhash._linked(fps, mask, 2) for a, b in zip(x, y)} == want


def test_every_close_pair_meets_in_a_list_and_the_tally_drops_others(spark, monkeypatch):
    rng = random.Random(11)
    tail = [sum(rng.getrandbits(1) << b for b in range(32)) for _ in range(120)]
    hot = {0xABCDEF01 << 32 | t ^ (1 << rng.randrange(32)) for t in tail for _ in range(6)} | {0xABCDEF01 << 32 | t for t in tail}
    fps = sorted(hot | {rng.getrandbits(64) for _ in range(300)})
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    for a, b in want:
        assert any((a ^ b) & m == 0 for m in simhash.PAIRED)
        assert all(any((a ^ b) & m == 0 for m in some) for first, some in zip(simhash.PAIRED, simhash.DEALT) if (a ^ b) & first == 0)
    few = np.array(sorted(hot), np.uint64)
    mask = simhash.PAIRED[-1]
    assert all(int(f) & mask == 0xABCDEF01 << 32 for f in few)
    got = {(int(few[i]), int(few[j])) for x, y in simhash._linked(few, mask, 2) for i, j in zip(x, y)}
    assert got == {(a, b) for a, b in want if a in hot and b in hot}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    root = groups(sorted(x for (x,) in signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for long in (4096, 50):  # no list is dealt again; the hot ones are
        monkeypatch.setattr(simhash, "LONG", long)
        found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
        assert {r.node: r.root for r in found} == {n: r for n, r in root.items() if Counter(root.values())[r] > 1}


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.keep_one(nothing).collect() == []


def test_near_copies_keep_one_and_leave_others(spark):
    rng = random.Random(4)
    texts = [[f"v{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))] for _ in range(120)]
    rows, want = [], {}
    for i, t in enumerate(texts):
        rows.append((i, " ".join(t), 1))
        want[i] = i
        for c in range(i % 4):  # copies with one to three words changed
            e = list(t)
            for _ in range(c):
                e[rng.randrange(len(e))] = f"n{rng.randrange(10**6)}"
            rows.append((1000 + 10 * i + c, " ".join(e).replace("v", "V", 5), 1))
            want[1000 + 10 * i + c] = i if simhash.similarity([w.encode() for w in t], [w.encode() for w in e]) >= 0.8 else None
    df = spark.createDataFrame(rows, "doc_id long, text string, least int")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    gone = {d for d, w in want.items() if w is not None and w != d}
    assert set(range(120)) <= kept and not kept & gone
    assert simhash.keep_one(df).columns == df.columns


def test_keep_one_of_nasty_rows(nasty):
    kept = nasty.sparkSession.createDataFrame(simhash.keep_one(nasty).collect(), nasty.schema)
    assert kept.columns == nasty.columns
    # One row is left of each text without words, null and empty alike, and of each repeated row.
    blank = kept.where(F.coalesce(F.trim(F.regexp_replace("text", r"\s", "")), F.lit("")) == "").count()
    assert blank == 1
    assert kept.groupBy("text").count().where("count > 1").count() == 0


def block_edits(rng, vocabulary, start):
    """Texts, and for each a copy with one block added, cut or replaced, of similarity just over 0.8: rows (id, text)."""
    rows = []
    for i in range(90):
        n = (60, 200, 1000)[i % 3]
        t = [rng.choice(vocabulary) for _ in range(n)]
        at, new = rng.randrange(n), [f"n{rng.randrange(10**6)}" for _ in range(n)]
        k = n // 6 if i // 3 % 3 else n // 11
        e = (t[:at] + new[: n // 11] + t[at + n // 11 :], t[:at] + new[:k] + t[at:], t[k:])[i // 3 % 3]
        rows += [(start + 2 * i, " ".join(t)), (start + 2 * i + 1, " ".join(e))]
    return rows


def similar_ids(rows):
    """Kept ids by comparing all pairs."""
    words = [t.lower().encode().split() for _, t in rows]
    sets = [set(zip(*(w[j:] for j in range(5)))) for w in words]
    root = groups(range(len(rows)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    return {rows[i][0] for i, r in root.items() if i == r}


def test_near_copies_with_a_block_edited_are_all_found(spark):
    rng = random.Random(8)
    rows = block_edits(rng, [f"v{i}" for i in range(4000)], 0)
    want = similar_ids(rows)
    assert len(want) < 130
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_pairs_in_long_lists_of_other_texts_are_found(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(30)]
    rows = []
    for i in range(400):  # the same words in another order: all share all keys of the byte index
        t = [w for _ in range(5) for w in rng.sample(vocabulary, 30)]
        rows.append((i, " ".join(t)))
        if i % 8 == 0:
            rows.append((1000 + i, " ".join(t[:70] + t[71:])))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(400))


def test_all_pairs_of_a_list_meet_once(spark):
    n = 2 * simhash.LIST + 40
    rows = [(h, 10 * i, 10 * (i // 2), 100, 3) for h in (1, 2) for i in range(n if h == 1 else 9)]
    got = simhash._list_pairs(spark.createDataFrame(rows, "h long, c long, root long, n long, pos long"), 0.8).collect()
    want = {(10 * i, 10 * j) for i in range(n) for j in range(i) if i // 2 != j // 2}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_pairs_left_by_the_bounds_are_no_more_than_can_be_similar(spark):
    """Every pair of random sets of similarity 0.8 or more leaves a list; frequent shingles come last in any order."""
    rng = random.Random(5)
    order = (np.array(sorted(rng.sample(range(1, 400), 60)), np.uint64), np.array([rng.randint(1, 5) for _ in range(60)]))
    sets = []
    for _ in range(40):
        base = rng.sample(range(1, 400), rng.randint(5, 120))
        for _ in range(4):
            sets.append(np.unique(np.array([x for x in base if rng.random() > 0.08] + rng.sample(range(400, 4000), rng.randint(0, 8)), np.uint64)))
    rows = []
    for i, x in enumerate(sets):
        rows += [(int(h), i, i, len(x), pos) for pos, h in enumerate(simhash.prefix(x, 0.8, order))]
    got = {(r.a, r.b) for r in simhash._list_pairs(spark.createDataFrame(rows, "h long, c long, root long, n long, pos long"), 0.8).collect()}
    whole = [set(x.tolist()) for x in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(whole[i] & whole[j]) >= 4 * len(whole[i] | whole[j])}
    assert len(want) > 50 and want <= got


def test_copies_of_one_text_that_are_not_similar_to_each_other(spark):
    """A text with copies at 0.80 to 0.85 from it, and copies just under that: all pairs decide."""
    rng = random.Random(12)
    rows = []
    for f in range(4):
        base = [f"v{rng.randrange(3000)}" for _ in range(150)]
        rows.append((1000 * f, " ".join(base)))
        for i in range(40):
            e = list(base)
            for at in rng.sample(range(0, 150, 5), rng.randint(2, 5)):
                e[at] = f"n{rng.randrange(10**6)}"
            rows.append((1000 * f + 1 + i, " ".join(e)))
    want = similar_ids(rows)
    assert 20 < len(want) < 140
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_groups_without_an_id_or_with_the_same_one_each_keep_a_document(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"v{rng.randrange(4000)}" for _ in range(80))
    t = [text() for _ in range(6)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1] + " more"), (7, t[2]), (7, t[3]), (7, t[3]), (7, t[4]), (8, t[4] + " more"), (None, t[4]), (9, t[5])]
    got = [(r.doc_id, r.text.removesuffix(" more")) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(got) == Counter([(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (7, t[4]), (9, t[5])])
