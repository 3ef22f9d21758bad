"""Relational operators on small cases, against plain code and their text for another engine."""

import itertools

import duckdb

from pagewright.operators import relational as B


def test_chains_of_many_pages(spark):
    """Chains end after four steps, count every way, and have no limit on rows in all."""
    matches = [(1, s, s) for s in range(1, 9)] + [(2, 1, 1), (2, 2, 5), (2, 2, 6), (2, 6, 3), (2, 7, 3), (2, 4, 9)] + [(3, 2, 2)] + [(p, s, s) for p in range(10, 60) for s in (1, 2, 3)]
    frame = spark.createDataFrame(matches, "page long, source long, target long")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = {(r.page, r.start): (r.steps, r.visits) for r in B.CHAINS(matches=frame).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {(1, 1): (4, 4), (2, 1): (4, 7)} | {(p, 1): (3, 3) for p in range(10, 60)}
    con = duckdb.connect()
    con.execute("CREATE TABLE matches (page BIGINT, source BIGINT, target BIGINT)")
    con.executemany("INSERT INTO matches VALUES (?, ?, ?)", matches)
    assert {(p, s): (n, v) for p, s, n, v in con.execute(B.CHAINS.text(matches="matches")).fetchall()} == got


def test_odd_pages_on_the_limit(spark):
    """A page exactly on the limit of its book isn't over it, whatever the order of its rows; one beyond it is, at any scale."""
    tied = [1, 3, 4, 5, 7]  # mean 4, spread 2, limit 7
    rows = [(b * 10 + i, b, v / 1.5) for b, order in enumerate(itertools.permutations(tied)) for i, v in enumerate(order)]
    rows += [(b * 10 + i, b, v * 1e-12) for b, order in ((200, [1, 1, 1, 1, 9]), (201, [3, 3, 3])) for i, v in enumerate(order)]
    frame = spark.createDataFrame(rows, "page long, book long, reprojection_error double")
    for parts in (1, 3):
        assert [r.page for r in B.ODD_PAGES(pages=frame.repartition(parts, "page") if parts > 1 else frame.coalesce(1)).collect()] == [2004]
