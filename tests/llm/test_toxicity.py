import random

import numpy as np

from folioloom.llm import toxicity


def corpus(n, rng):
    clean = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(1, 200))]
        bad = i % 6 == 0
        for _ in range(rng.randint(1, 6) if bad else 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["Nasty!", "vile", f"slur{rng.choice('abcdefgh')}{rng.choice('xyz')}"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy_and_order(spark):
    rows = corpus(1500, random.Random(1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 900], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    assert len(m.thresholds) == 2 and (np.diff(m.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    wrong = sum((got[i].expected_severity >= toxicity.REJECT) != bool(t) for i, _, t in rows[900:])
    assert wrong <= 6
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and abs(r.expected_severity - sum(k * p for k, p in enumerate(r.probabilities))) < 1e-9 for r in got.values())
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert (again.weights == m.weights).all()
    kept = toxicity.keep_clean(docs, m)
    assert kept.count() == sum(r.expected_severity < toxicity.REJECT for r in got.values())


def test_three_given_grades_share_weights():
    rng = random.Random(2)
    docs, grades = [], []
    for _ in range(900):
        g = rng.randrange(3)
        t = " ".join([rng.choice(["aaa", "bbb", "ccc"]) for _ in range(20)] + ["awful"] * (0, 1, 12)[g])
        docs.append(toxicity.features(t))
        grades.append(g)
    m = toxicity.fit(docs, np.array(grades))
    for n, g in ((0, 0), (1, 1), (12, 2)):
        assert m.probabilities("aaa bbb " + "awful " * n).argmax() == g


def test_nulls_empty_and_no_labels(spark, nasty, nothing):
    labels = spark.createDataFrame([(0, 0), (1, 0), (None, 1), (2, None), (0, 0)], "doc_id long, toxic int")
    m = toxicity.train(nasty, labels)
    assert {r.grade for r in toxicity.score(nasty, m).collect()} == {0} and toxicity.score(nasty, m).count() == nasty.count()
    assert toxicity.score(nothing, m).collect() == [] and toxicity.keep_clean(nothing, m).collect() == []
    none = toxicity.train(nothing, labels)
    assert toxicity.keep_clean(nasty, none).count() == nasty.count()
    all_toxic = toxicity.train(nasty, spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, toxic int"))
    assert {r.grade for r in toxicity.score(nasty, all_toxic).collect()} == {1}


def test_the_fit_is_the_optimum_that_another_method_finds():
    """The same loss, written out plainly, is brought down by gradient steps whose length is searched for; both end at the same severities."""
    rng = np.random.default_rng(3)
    n, k = 240, 6
    truth = np.array([1.5, 1.0, 0.8, 0.5, 1.2, 0.9])
    docs, labels = [], []
    for _ in range(n):
        counts = rng.integers(0, 3, k)
        z = np.log2(1 + counts) @ truth + rng.logistic()
        docs.append((np.array([7, 99, 1000, 5, 42, 77])[counts > 0], counts[counts > 0].astype(float), 10))
        labels.append(int(z > 2.5) + int(z > 4.5))
    labels = np.array(labels)
    model = toxicity.fit(docs, labels)
    chosen = np.flatnonzero(model.weights)
    x = np.zeros((n, len(chosen)))
    for i, (at, counts, _) in enumerate(docs):
        for b, c in zip(at, counts):
            if b in chosen:
                x[i, list(chosen).index(b)] = np.log2(1 + c)

    def loss(p):
        w, theta = p[: len(chosen)], np.array([p[-2], p[-2] + np.exp(p[-1])])
        below = 1 / (1 + np.exp(-(theta[None, :] - (x @ w)[:, None])))
        share = np.diff(np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1), axis=1)[np.arange(n), labels]
        return -np.log(np.maximum(share, 1e-12)).mean() + toxicity.DECAY * (w @ w) / 2 / len(chosen) ** 0.5

    def slope(p):
        return np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(len(p)) * 1e-5])

    p, inverse = np.concatenate([np.zeros(len(chosen)), [1.0, 0.0]]), np.eye(len(chosen) + 2)
    g = slope(p)
    for _ in range(200):  # quasi-Newton steps (BFGS) with halving
        step = -inverse @ g
        t = 1.0
        while loss(p + t * step) > loss(p) + 1e-4 * t * (g @ step) and t > 1e-10:
            t /= 2
        new = p + t * step
        h = slope(new)
        d, y = new - p, h - g
        if y @ d > 1e-14:
            r = 1 / (y @ d)
            left = np.eye(len(p)) - r * np.outer(d, y)
            inverse = left @ inverse @ left.T + r * np.outer(d, d)
        p, g = new, h
        if np.abs(g).max() < 1e-7:
            break
    own = np.concatenate([model.weights[chosen], [model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])]])
    assert np.abs(g).max() < 1e-4
    assert loss(own) - loss(p) < 1e-4 and np.abs(own - p).max() < 0.05
