import numpy as np

from pagewright.llm.neighbours import cosine, nearest

INF, NAN = float("inf"), float("nan")


def brute(rows, queries, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8}
    ids = np.array(sorted(ok))
    out = {}
    for q in queries:
        if q in ok:
            others = ids[ids != q]
            s = cosine(np.array([ok[i] for i in others]).reshape(-1, 8), np.tile(ok[q], (len(others), 1))) if len(others) else np.zeros(0)
            order = np.lexsort((others, -s))[:k]
            out[q] = [(int(others[i]), s[i]) for i in order]
    return out


def run(spark, rows, queries, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, df.filter(df.vec_id.isin(queries)), **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_small_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(12)] + [(200, None), (201, [0.0] * 8), (202, [NAN] * 8), (203, [INF] * 8), (204, [1.0] * 7), (205, [None] * 8), (None, [1.0] * 8)]
    queries = [0, 10, 50, 100, 111, 200, 201]
    want = brute(rows, queries, 5)
    got = run(spark, rows, queries)
    assert set(got) == set(want) and all(len(got[q]) == 5 for q in got)
    assert sum(len({*want[q]} & {*got[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert [v for v, _ in got[111]] == [0, 100, 101, 102, 103]
    assert run(spark, rows[:3], [0]) == brute(rows[:3], [0], 5)
    assert run(spark, rows[:1], [0]) == {}
    assert run(spark, [(1, None)], [1]) == {}
    # Two rows of one id: one query, two candidates.
    twice = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.2, 1.0])]
    assert [v for v, _ in run(spark, twice, [1])[1]] == [3, 2]
    assert [v for v, _ in run(spark, twice, [2])[2]] == [1, 3, 1]


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 8))
    x = (centres[rng.integers(0, 10, 6000)] + rng.normal(size=(6000, 8))).astype(np.float32)
    x[1000:2500] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = list(range(0, 6000, 50))
    want, got = brute(rows, queries, 5), run(spark, rows, queries)
    hit = sum(len({v for v, _ in want[q]} & {v for v, _ in got.get(q, [])}) for q in queries)
    assert hit >= 0.93 * 5 * len(queries)
    assert all(len(got[q]) == 5 for q in queries)
    assert got[1000] == want[1000]
