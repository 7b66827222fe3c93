import random
import re

from folioloom.llm import decontaminate


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(t, k=5):
    w = words(t)
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def held(item, text):
    """Shingles of an item, and how many a text holds; an item under five words is one shingle."""
    k = min(5, len(words(item)))
    return len(shingles(item, k)), len(shingles(item, k) & shingles(text, k))


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    items += [(100, items[5][1].upper() + "!"), (101, None), (102, "")]
    docs = []
    for d in range(150):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 300))]
        if d % 2:
            x = words(items[rng.randrange(40)][1])
            cut = rng.randint(0, max(1, len(x) // 3))
            t[len(t) // 2 : len(t) // 2] = x[cut:] if d % 4 == 1 else x
        docs.append((d, " ".join(t).replace("t1 ", "T1, "), "s"))
    docs += [(None, items[7][1], "s"), (151, None, "s"), docs[1], (3, "another text of the same id", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, h string")
    it = spark.createDataFrame(items, "item_id long, text string")
    classes = {}
    for i, t in items:
        if words(t):
            classes.setdefault(tuple(words(t)), []).append(i)
    want = {}
    for d, t, _ in docs:
        for same in classes.values():
            q, n = held(dict(items)[min(same)], t)
            if n / q >= 0.8:
                want[d, min(same)] = max(want.get((d, min(same)), (0,)), (n / q, len(same), q))
    got = decontaminate.contaminated(df, it).collect()
    assert {(r.doc_id, r.item_id): (r.containment, r.n_items, r.n_shingles) for r in got} == want and len(got) == len(want)
    assert any(len(words(dict(items)[i])) < 5 for _, i in want)
    for least in (1, 5):
        clean = decontaminate.keep_clean(df, it, least_words=least)
        bad = {(d, t) for d, t, _ in docs for s in classes if len(s) >= least and (x := held(" ".join(s), t))[1] >= 0.8 * x[0]}
        assert sorted(map(str, clean.collect())) == sorted(str(r) for r in df.collect() if (r.doc_id, r.text) not in bad)


def test_plan_is_native(spark, nasty):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    out = decontaminate.contaminated(nasty, items)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables(spark, nothing, nasty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(nothing, items).collect() == []
    assert decontaminate.contaminated(nasty, items).collect() == []
    assert decontaminate.keep_clean(nasty, items).count() == nasty.count()
