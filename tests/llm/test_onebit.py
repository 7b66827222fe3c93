import numpy as np

from folioloom.llm import onebit


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, x in good:
        if i % 50 == 0:
            s = sorted(((-onebit.cosine(x, y), j) for j, y in good if j != i and len(y) == len(x)))[:k]
            for r, (c, j) in enumerate(s, 1):
                out[i, r] = (j, -c)
    return out


def check(rows, spark, k=5):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n int, q int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in onebit.nearest(df, df.where("vec_id % 50 = 0"), k).collect()}
    want = brute([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()], k)
    return got, want


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(3000)]
    got, want = check(rows, spark)
    assert got.keys() == want.keys()
    found = {(q, v) for (q, _), (v, _) in got.items()}
    assert len(found & {(q, v) for (q, _), (v, _) in want.items()}) >= 0.99 * len(want)
    assert all(got[x] == want[x] for x in want if got[x][0] == want[x][0])


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    one = rng.standard_normal(8).tolist()
    rows = [(i, one) for i in range(120)] + [(200 + i, rng.standard_normal(8).tolist()) for i in range(30)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [1.0, None] + [0.0] * 6), (305, [float("inf")] + [0.0] * 7), (None, one), (350, [1.0, 2.0])]
    got, want = check(rows, spark)
    assert got == want


def test_few_candidates_and_empty(spark):
    got, want = check([(0, [1.0, 0.0]), (1, [1.0, 1.0])], spark)
    assert got == want and len(got) == 1
    got, want = check([], spark)
    assert got == want == {}


def test_the_bound_holds():
    rng = np.random.default_rng(2)
    for d in (64, 100, 7):
        x = rng.standard_normal((500, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        turn = onebit.rotation(d)
        assert np.allclose(turn @ turn.T, np.eye(d))
        codes, scalar = onebit.encode(x, turn)
        turned = x[:50] @ turn.T
        est, bound = onebit.Rounded(turned).estimate(codes, scalar)
        plain = turned @ np.where(x @ turn.T > 0, 1, -1).T / np.sqrt(d) / scalar
        off = ~np.eye(50, 500, dtype=bool)
        assert codes.shape == (500, -(-d // 64)) and codes.dtype == np.uint64
        assert (np.abs(est - plain) <= onebit.Rounded(turned).error / scalar + 1e-9).all()  # what rounding the query adds is known
        assert (np.abs(est - x[:50] @ x.T) <= bound)[off].mean() > 0.99


def test_vectors_near_each_other_leave_few_survivors(spark, monkeypatch):
    """Of clustered vectors those of the query's cluster are fetched; many blocks and cells give what one gives."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 96))
    rows = [(i, (centres[i % 40] + 0.1 * rng.standard_normal(96)).tolist()) for i in range(2000)]
    fetched = []
    cosines = onebit._cosines

    def spy(wanted, *more):
        fetched.append(sum(len(r.pairs) // 8 for r in wanted.collect()))
        return cosines(wanted, *more)

    monkeypatch.setattr(onebit, "_cosines", spy)
    monkeypatch.setattr(onebit, "QUERY_BLOCK", 8)
    monkeypatch.setattr(onebit, "CELL_ROWS", 300)
    got, want = check(rows, spark)
    assert got == want and fetched[0] == 40 * 4 * 5 and fetched[1] < 0.1 * 40 * 2000


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    got, want = check(rows, spark)
    again, _ = check(rows + [r for r in rows for _ in range(3)], spark)
    assert got == want == again


def test_many_survivors_take_a_bit_of_each_pair(spark, monkeypatch):
    """Of random vectors a large part survives; what is written of them stays under a bit for each query and vector of a block."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(4000)]
    told = []
    cosines = onebit._cosines

    def spy(wanted, *more):
        told.append([len(r.pairs) for r in wanted.collect()])
        return cosines(wanted, *more)

    monkeypatch.setattr(onebit, "_cosines", spy)
    got, want = check(rows, spark)
    assert got.keys() == want.keys() and sum(got[x] == want[x] for x in want) >= 0.99 * len(want)
    assert sum(told[1]) <= 80 * (4000 / 8 + len(told[1])) + len(told[1])


def test_packed_pairs_are_read_as_they_were():
    rng = np.random.default_rng(9)
    for n, m, share in ((3, 5, 0.5), (7, 13, 0.9), (1, 1, 1.0), (40, 2048, 0.3), (40, 333, 0.001), (5, 8, 0.0), (9, 1, 0.5)):
        keep = rng.random((n, m)) < share
        blob = onebit._packed_of(keep)
        assert len(blob) <= n * -(-m // 8) + 1
        assert {(i, j) for i, js in onebit._by_query(blob, m) for j in js.tolist()} == set(zip(*(x.tolist() for x in np.nonzero(keep))))
