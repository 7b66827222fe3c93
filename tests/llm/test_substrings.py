import hashlib
import random
from collections import Counter

import numpy as np

from folioloom.llm import substrings

FAR = 1 << 63


def brute(rows, k):
    """(doc_id, n_words, n_removed, digest) of each row; rows of one id are one document."""
    at = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        d = FAR if doc is None else doc
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            at[g] = min(at.get(g, (d, p)), (d, p))
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        d = FAR if doc is None else doc
        gone = set()
        for p in range(len(w) - k + 1):
            if at[tuple(w[p : p + k])] < (d, p):
                gone.update(range(p, p + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_random_texts_against_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))] for _ in range(25)]
    rows = []
    for i in range(60):
        parts = [rng.choice(base)[rng.randint(0, 20) :][: rng.randint(1, 40)] for _ in range(rng.randint(1, 3))]
        rows.append((i, " ".join(x for p in parts for x in p)))
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200, "z " * 50), (201, "y z " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, a in ((3, 2), (6, 3), (20, 8)):
        assert result(substrings.dedup(df, k, a)) == brute(rows, k)


def test_nulls_repeats_and_odd_columns(nasty):
    rows = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    assert result(substrings.dedup(nasty)) == brute(rows, 20)


def test_rows_that_share_an_id_are_one_document(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:25])), (1, " ".join(["x"] * 3 + words[:25])), (0, " ".join(words[10:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substrings.dedup(df, 5, 3)) == brute(rows, 5)


def test_empty_table(nothing):
    assert substrings.dedup(nothing).collect() == []


def test_text_and_spans(spark):
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a  b " + " ".join(words) + " c")], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.dedup(df, with_text=True).collect()}
    assert got[2].kept == "a b c" and [tuple(x) for x in got[2].removed] == [(2, 30)] and got[1].n_removed == 0


def test_every_window_of_equal_words_has_one_anchor():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 5, 400).astype(np.uint64)
    where, runs = substrings.anchors(w, 12, 4)
    seen = {}
    for i, p in enumerate(where):
        assert i <= p <= i + 8
        assert seen.setdefault(tuple(w[i : i + 12]), (p - i, runs[p])) == (p - i, runs[p])


def test_a_path_joined_by_a_false_hash_is_cut_again(spark):
    # Places of a path with two sequences of words: the first of either stays, and later ones of either go.
    text = " ".join(f"w{i}" for i in range(30))
    other = text.replace("w3 ", "v3 ")
    kind = "f_key long, first_doc long, places array<struct<path:long,place:int,length:int,source:boolean>>"
    shown = spark.createDataFrame([(k, k - 6, [(5, 0, 1, k == 7)]) for k in (7, 8, 9, 10)], kind)
    d = spark.createDataFrame([(1, 7, text), (2, 8, other), (3, 9, other + " x"), (4, 10, text + " y")], "doc_id long, text_key long, text string")
    from pyspark.sql import functions as F

    def cut(s):
        rows = d.join(s, d["text_key"] == s["f_key"])
        return substrings._cut(rows.select("doc_id", "text_key", "text", "places", F.lit(False).alias("copy")), 20, False)

    out = cut(shown)
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 20, 3: 20, 4: 20}
    told = out.select("text_key", F.explode(F.arrays_zip("path", "place", "digest", "source")).alias("x")).select("text_key", "x.*")
    false = spark.createDataFrame([(5,)], "path long")
    assert {r.doc_id: r.n_removed for r in substrings._recut(out, shown, told, false, cut).collect()} == {1: 0, 2: 0, 3: 20, 4: 20}


def test_paths_are_maximal_and_nonbranching(spark):
    """Unitigs of a text by walking its graph of windows in one place."""
    rng = random.Random(4)
    base = [[rng.choice("abcd") for _ in range(30)] for _ in range(4)]
    texts = [[x for _ in range(3) for x in rng.choice(base)[rng.randint(0, 9) :]] for _ in range(12)]
    k = 4
    rows = [(i, i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, None) for r in rows], "text_key long, doc long, text string, repeated array<long>")
    every = substrings.hashes  # all windows' anchors are taken as repeated
    runs = [np.unique(substrings.anchors(every([w.encode() for w in t]), k, 2)[1]).view(np.int64).tolist() for t in texts]
    df = spark.createDataFrame([(*r, x) for r, x in zip(rows, runs)], "text_key long, doc long, text string, repeated array<long>")
    got = {(r.doc, r.place): r.length for r in substrings._paths(substrings._edge_rows(df, k, 2), True).collect()}
    first, after, before, n = {}, {}, {}, Counter()
    for i, t in enumerate(texts):
        w = [tuple(t[p : p + k]) for p in range(len(t) - k + 1)]
        for p, e in enumerate(w):
            first.setdefault(e, (i, p))
            n[e] += 1
            after.setdefault(e, set()).add(w[p + 1] if p + 1 < len(w) else None)
            before.setdefault(e, set()).add(w[p - 1] if p else None)
    follows = lambda e: next(iter(after[e])) if len(after[e]) == 1 and None not in after[e] else None
    leads = lambda e: next(iter(before[e])) if len(before[e]) == 1 and None not in before[e] else None
    joined = {e: s for e in first if n[e] > 1 and (s := follows(e)) and leads(s) == e and first[s] == (first[e][0], first[e][1] + 1) and n[s] > 1}
    want = {}
    for e in (e for e in first if n[e] > 1 and e not in set(joined.values())):
        length, x = 1, e
        while x in joined:
            x, length = joined[x], length + 1
        want[first[e]] = length
    assert got == want and max(want.values()) > 3


def test_ten_thousand_repeats_of_a_row(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = [f"v{rng.randint(0, 400)}" for _ in range(1040)]
    rows = [(None, " ".join(words))] * 10_000 + [(3, " ".join(["a", *words[100:300], "b", *words[500:600]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substrings.dedup(df).groupBy("doc_id", "n_words", "n_removed").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {(None, 1040, 300, 10_000), (3, 302, 0, 1)}
