"""Assignments of the same total: which one is taken."""

import duckdb
import numpy as np

from pagewright.operators import grouped as G
from pagewright.operators import pairing as N


def test_later_of_equal_rows(spark):
    """Sources that cost the same leave the earlier ones without a target, directly or by others' moves, as in the SQL."""
    rng = np.random.default_rng(5)
    tables = {
        1: np.array([[4.0], [3.0], [3.0], [5.0]]) / 8,
        2: np.array([[1.0, 6], [2, 1], [1, 6], [9, 9]]) / 8,
        # The third source takes the first one's target only as the second moves: 1+1 = 1+1 = 2.
        3: np.array([[1.0, 5], [1, 1], [7, 1]]) / 8,
    }
    for page in range(4, 40):
        n = int(rng.integers(3, 7))
        tables[page] = np.round(rng.permutation(1 + np.arange(n * 2)).reshape(n, 2))[rng.integers(0, n, n + 2)] / 16
    rows = [(p, i + 1, j + 1, float(c)) for p, t in tables.items() for (i, j), c in np.ndenumerate(t)]
    got = sorted((r.page, r.source, r.target) for r in G.assigned(spark.createDataFrame(rows, "page long, source long, target long, cost double")).collect())
    by_page = {p: [(s, t) for q, s, t in got if q == p] for p in tables}
    assert by_page[1] == [(3, 1)] and by_page[2] == [(2, 2), (3, 1)] and by_page[3] == [(2, 1), (3, 2)]
    con = duckdb.connect()
    con.execute("CREATE TABLE costs (page BIGINT, source BIGINT, target BIGINT, cost DOUBLE)")
    con.executemany("INSERT INTO costs VALUES (?, ?, ?, ?)", rows)
    want = {(p, s) for p, s, _ in con.execute(f"SELECT page, source, target FROM ({N.ASSIGNED.text(costs='costs')}) q").fetchall()}
    assert {(p, s) for p, s, _ in got} == want


def test_later_rows_keeps_the_total():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n, m = int(rng.integers(2, 9)), int(rng.integers(1, 5))
        cost = rng.integers(0, 4, (n, m)) / 4.0
        first = G.assign(cost)
        then = G.later_rows(cost, first)
        assert len({j for _, j in then}) == len(then) == len(first) and abs(sum(cost[k] for k in then) - sum(cost[k] for k in first)) < 1e-9
        assert sorted((i for i, _ in then), reverse=True) >= sorted((i for i, _ in first), reverse=True)
