import itertools

import numpy as np

from pagewright.operators import grouped as G
from pagewright.streaming import history as H


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (1, 4), (4, 1), (3, 5), (5, 3), (6, 6)] * 5:
        cost = rng.random((n, m))
        pairs = G.assign(cost)
        assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        if n <= m:
            best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(cost[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(n), m))
        assert abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9
    assert G.assign(np.zeros((0, 3))) == []


def test_alignment_is_cheapest():
    rng = np.random.default_rng(1)

    def brute(cost):
        n, m = cost.shape
        best = (n + m) * G.GAP
        for k in range(1, min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.combinations(range(m), k):
                    best = min(best, sum(cost[i, j] for i, j in zip(rows, cols)) + (n + m - 2 * k) * G.GAP)
        return best

    for n, m in [(0, 3), (3, 0), (1, 1), (4, 5), (5, 5), (5, 3)]:
        cost = rng.random((n, m)) * 1.4
        for band in (None, 8):
            pairs = G.align(n, m, lambda i, j: cost[i, j], band=band)
            if pairs is None:
                continue
            total = sum(cost[i, j] for i, j in pairs) + (n + m - 2 * len(pairs)) * G.GAP
            assert abs(total - brute(cost)) < 1e-9
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))


def test_small_pieces():
    assert G.increasing_subset([]) == []
    # More anchors come before heavier ones; of as many the heavier, of equals the first.
    assert G.increasing_subset([(0, 5, 3.0), (1, 1, 1.0), (2, 2, 1.0)]) == [1, 2]
    assert G.increasing_subset([(0, 5, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 0, 3.0)]) == [1, 2]
    assert G.increasing_subset([(0, 0, 1.0), (1, 3, 3.0), (2, 1, 1.0), (3, 2, 1.0)]) == [0, 2, 3]
    assert G.increasing_subset([(0, 2, 1.0), (1, 1, 3.0)]) == [1]
    assert G.increasing_subset([(0, 2, 1.0), (1, 1, 1.0)]) == [0]
    boxes = np.array([[0, 0, 10, 10], [0, 0, 10, 9], [20, 0, 30, 10], [0, 0, 0, 0]], float)
    assert G.greedy_keep(boxes, 0.62, False) == [0, 2, 3]
    points = np.array([[i % 3, i % 2] for i in range(8)] + [[50 + i % 3, 40 + i % 2] for i in range(8)], float)
    assert sorted(np.bincount(G.two_groups(points))) == [8, 8]
    assert set(G.two_groups(points[:9])) == {0}


def test_groups_are_walked(spark):
    rows = [(p, r, float(10 * r), 0.0, 10.0 * r + 9, 9.0, 0.5 + r / 100) for p in range(300) for r in range(p % 7 + 1)]
    df = spark.createDataFrame(rows, "page long, rid long, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert G.suppress(df).count() == len(rows)
    pairs = G.greedy_pairs(df, df).collect()
    assert len(pairs) == len(rows) and all(p.source == p.target for p in pairs)
    assert G.split_compounds(df).count() == len(rows)
    books = df.selectExpr("page AS book", "rid AS page", "rid AS ord", "x0 / 100 AS value")
    out = G.align_pages(books, books.filter("page <> 2")).collect()
    assert all(r.source == r.target for r in out if r.target is not None)
    assert sum(r.target is None for r in out) == sum(1 for r in rows if r[1] == 2)


def test_undo_and_redo(spark):
    log = [("record", "a"), ("record", "a"), ("record", "b"), ("undo", None), ("undo", None), ("redo", None), ("record", "c"), ("redo", None), *[("record", f"s{i}") for i in range(60)]]
    df = spark.createDataFrame([(1, i, i, c, s) for i, (c, s) in enumerate(log)], "run long, ts long, event_id long, command string, state string")
    out = {r.event_id: (r.state, r.undo, r.redo) for r in H.replay(df).collect()}
    assert out[1] == ("a", 0, 0) and out[2] == ("b", 1, 0) and out[3] == ("a", 0, 1) and out[4] == ("a", 0, 1)
    assert out[5] == ("b", 1, 0) and out[6] == ("c", 2, 0) and out[7] == ("c", 2, 0)
    assert out[len(log) - 1] == ("s59", 50, 0)


def test_stream_agrees_with_replay(spark, tmp_path):
    log = [(k % 3, i, i, ["record", "record", "undo", "redo"][(i * 7 + k) % 4], f"s{i % 5}") for i in range(60) for k in range(3)]
    schema = "run long, ts long, event_id long, command string, state string"
    df = spark.createDataFrame(log, schema)
    for part in range(3):
        df.filter((df.ts >= part * 20) & (df.ts < part * 20 + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    want = sorted(map(tuple, H.replay(df).collect()), key=str)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/log")
    query = H.stream(read).writeStream.format("memory").queryName("history").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("SELECT * FROM history").collect()), key=str) == want
