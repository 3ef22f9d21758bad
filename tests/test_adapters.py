"""Made-up measures that any engine derives alike."""

import duckdb

from pagewright.operators import policies as P
from pagewright.plans import adapters as A

SF = "/root/testdata/sf0.001"


def test_sizes_are_rounded(spark):
    """Prices next to a whole number or halfway give the size the other engine's cast gives, and with it the same verdict."""
    prices = [16383.4, 16383.5, 16383.6, 16384.5, 16385.5, 39999.7, 56383.99, None]
    rows = [(k * 5 + 1, k, p) for k, p in enumerate(prices)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double")
    got = sorted(tuple(r) for r in A.SIZED_PAGES(orders=orders).select("book", "page", "bytes").collect())
    assert [r[2] for r in got] == [16383, 16384, 16384, 16384, 16386, 0, 16384, None]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW region AS SELECT * FROM '{SF}/region.parquet'")
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?)", rows)
    there = A.SIZED_PAGES.text(orders="orders")
    assert got == sorted(con.execute(f"SELECT book, page, bytes FROM ({there}) q").fetchall())
    ahead = P.AHEAD(pages=A.SIZED_PAGES(orders=orders), sixteen=A.SIXTEEN(region=spark.read.parquet(f"{SF}/region.parquet")))
    want = con.execute(f"SELECT book, sizes, worthwhile FROM ({P.AHEAD.text(pages=there, sixteen=A.SIXTEEN.text(region='region'))}) q").fetchall()
    assert sorted(tuple(r) for r in ahead.select("book", "sizes", "worthwhile").collect()) == sorted(want) and [w for _, _, w in sorted(want)] == [False, True, True, True, True, False, True]
