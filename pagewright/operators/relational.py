"""Relational operators beside the domain's own: as-of and full outer joins, set operations, cubes, ranks, frames, percentiles, chains, estimates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..plans.relation import Operator, Relation

#: The last state of a run at or before each mark of time: marks and states in one ordered pass, so that nothing is paired.
AS_OF = Relation("""
SELECT run, mark, at AS marked_at, state, state_at FROM (
  SELECT run, mark, at, last_value(stage, true) OVER w AS state, last_value(stage_at, true) OVER w AS state_at
  FROM (SELECT run, event_id AS mark, ts AS at, CAST(NULL AS STRING) AS stage, CAST(NULL AS TIMESTAMP) AS stage_at, 1 AS later FROM {marks} UNION ALL SELECT run, NULL, ts, stage, ts, 0 FROM {states}) u
  WINDOW w AS (PARTITION BY run ORDER BY at, later, stage ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) x WHERE mark IS NOT NULL""",
"""
SELECT m.run AS run, m.event_id AS mark, m.ts AS marked_at, s.stage AS state, s.ts AS state_at FROM {marks} m ASOF LEFT JOIN (SELECT run, ts, max(stage) AS stage FROM {states} GROUP BY run, ts) s ON s.run = m.run AND s.ts <= m.ts""")  # fmt: skip

#: Regions of both editions side by side, whichever side has them.
EDITIONS = Relation("""
SELECT coalesce(s.page, t.page) AS page, coalesce(s.rid, t.rid) AS rid, s.kind AS source_kind, t.kind AS target_kind, CASE WHEN s.page IS NULL THEN 'target' WHEN t.page IS NULL THEN 'source' ELSE 'both' END AS sides
FROM {source} s FULL OUTER JOIN {target} t ON t.page = s.page AND t.rid = s.rid AND t.kind = s.kind""")

#: Kinds of a page that both editions have, and that only the first has.
COMMON_KINDS = Relation("SELECT page, kind FROM {source} s INTERSECT SELECT page, kind FROM {target} t")
LOST_KINDS = Relation("SELECT page, kind FROM {source} s EXCEPT SELECT page, kind FROM {target} t")

#: Counts and means over all combinations of book group and kind, and over chosen ones.
KIND_CUBE = Relation("SELECT coalesce(CAST(grp AS STRING), '*') AS grp, coalesce(kind, '*') AS kind, count(*) AS n, sum(text_len) AS chars FROM (SELECT page % 5 AS grp, kind, text_len FROM {regions} r) x GROUP BY CUBE (grp, kind)")
KIND_SETS = Relation("SELECT coalesce(CAST(grp AS STRING), '*') AS grp, coalesce(kind, '*') AS kind, count(*) AS n FROM (SELECT page % 5 AS grp, kind FROM {regions} r) x GROUP BY GROUPING SETS ((grp), (kind), ())")

#: Where a region stands among those of its page, by confidence.
RANKS = Relation("""
SELECT page, rid, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS percent, round(cume_dist() OVER w, 9) AS below, dense_rank() OVER w AS grade, first_value(rid) OVER w AS least
FROM {regions} r WINDOW w AS (PARTITION BY page ORDER BY confidence, rid)""")
#: Means over rows and ranges around a region in reading order.
FRAMES = Relation("""
SELECT page, rid, round(avg(confidence) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS around, count(*) OVER (PARTITION BY page ORDER BY y0 RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM {regions} r""")
#: Middle and high values of a kind.
PERCENTILES = Relation(
    "SELECT kind, round(percentile(confidence, 0.5), 9) AS middle, round(percentile(confidence, 0.95), 9) AS high, min(confidence) AS low FROM {regions} r GROUP BY kind",
    "SELECT kind, round(quantile_cont(confidence, 0.5), 9) AS middle, round(quantile_cont(confidence, 0.95), 9) AS high, min(confidence) AS low FROM {regions} r GROUP BY kind",
)
#: The surest regions of all.
SUREST = Relation("SELECT page, rid, confidence FROM {regions} r ORDER BY confidence DESC, page, rid LIMIT 100")
#: Pages by day and week of their book's orders.
CALENDAR = Relation("""
SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month, count(*) AS pages, min(datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01')) AS first_day, max(quarter(CAST(o_orderdate AS DATE))) AS quarter FROM {orders} o GROUP BY 1""",
"""
SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month, count(*) AS pages, min(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS first_day, max(quarter(CAST(o_orderdate AS DATE))) AS quarter FROM {orders} o GROUP BY 1""")  # fmt: skip
#: Chains of matches followed from each page's first region, target by target: four steps at most, each over the matches of the page, which are
#: read once (recursion would plan them anew for every step and stops at a million rows in all).
CHAINS = Relation(
    """
WITH p AS (SELECT page, collect_list(named_struct('source', source, 'target', target)) AS found FROM {matches} m GROUP BY page),
a AS (SELECT page, found, filter(found, m -> m.source = 1) AS one FROM p),
b AS (SELECT page, found, one, flatten(transform(one, w -> filter(found, m -> m.source = w.target + 1))) AS two FROM a),
c AS (SELECT page, found, one, two, flatten(transform(two, w -> filter(found, m -> m.source = w.target + 1))) AS three FROM b),
d AS (SELECT page, one, two, three, flatten(transform(three, w -> filter(found, m -> m.source = w.target + 1))) AS four FROM c)
SELECT page, CAST(1 AS BIGINT) AS start, CAST(CASE WHEN size(four) > 0 THEN 4 WHEN size(three) > 0 THEN 3 WHEN size(two) > 0 THEN 2 ELSE 1 END AS BIGINT) AS steps, CAST(size(one) + size(two) + size(three) + size(four) AS BIGINT) AS visits
FROM d WHERE size(one) > 0""",
    """
WITH RECURSIVE walk(page, start, rid, steps) AS (
  SELECT page, source, target, CAST(1 AS BIGINT) FROM {matches} m WHERE source = 1
  UNION ALL
  SELECT w.page, w.start, m.target, w.steps + 1 FROM walk w JOIN {matches} m ON m.page = w.page AND m.source = w.rid + 1 WHERE w.steps < 4
) SELECT page, start, max(steps) AS steps, count(*) AS visits FROM walk GROUP BY page, start""",
)
#: Pages that differ from the mean of their book by more than one and a half times its spread: a subquery for each book.  Sums of doubles
#: change in their last bits with the order of rows, so a page that stands on the limit but for 1e-9 of the values isn't over it, in any order.
ODD_PAGES = Relation(
    """
SELECT p.page AS page FROM {pages} p WHERE p.reprojection_error > (SELECT avg(q.reprojection_error) + 1.5 * stddev_pop(q.reprojection_error) + 1e-9 * avg(abs(q.reprojection_error)) FROM {pages} q WHERE q.book = p.book)""",
    """
SELECT p.page AS page FROM {pages} p WHERE p.reprojection_error > (SELECT avg(q.reprojection_error) + 1.5 * stddev_pop(q.reprojection_error) FROM {pages} q WHERE q.book = p.book)""",
)


@F.pandas_udf(T.DoubleType())
def geometric_mean(values: pd.Series) -> float:
    """The geometric mean of positive values, by logarithms."""
    import numpy as np

    return float(np.exp(np.log(values.clip(lower=1e-12)).mean())) if len(values) else float("nan")


MEAN_CONFIDENCE = Operator(
    lambda regions: regions.groupBy("page").agg(F.round(geometric_mean("confidence"), 9).alias("mean")),
    "SELECT page, round(exp(avg(ln(greatest(confidence, 1e-12)))), 9) AS mean FROM {regions} r GROUP BY page",
)


@udtf(returnType=T.StructType([T.StructField("cell_x", T.IntegerType()), T.StructField("cell_y", T.IntegerType())]))
class Cells:
    """The cells of a grid that a box covers."""

    def eval(self, x0: float, y0: float, x1: float, y1: float, size: int) -> Iterator[tuple[int, int]]:
        for x in range(int(x0 // size), int(x1 // size) + 1):
            for y in range(int(y0 // size), int(y1 // size) + 1):
                yield x, y


def _covered(regions: DataFrame) -> DataFrame:
    regions.sparkSession.udtf.register("grid_cells", Cells)
    return regions.sparkSession.sql("SELECT r.page AS page, c.cell_x AS cell_x, c.cell_y AS cell_y, count(*) AS n FROM {regions} r, LATERAL grid_cells(r.x0, r.y0, r.x1, r.y1, 128) c GROUP BY r.page, c.cell_x, c.cell_y", regions=regions)


GRID_CELLS = Operator(
    _covered,
    """
SELECT page, cell_x, cell_y, count(*) AS n FROM (
  SELECT page, cell_x, unnest(range(CAST(floor(y0 / 128) AS BIGINT), CAST(floor(y1 / 128) AS BIGINT) + 1)) AS cell_y FROM (
    SELECT page, y0, y1, unnest(range(CAST(floor(x0 / 128) AS BIGINT), CAST(floor(x1 / 128) AS BIGINT) + 1)) AS cell_x FROM {regions} r) a) b GROUP BY page, cell_x, cell_y""",
)


def estimates(regions: DataFrame) -> DataFrame:
    """Estimates of a kind: different lengths of text, the middle and the high confidence; no exact counterpart."""
    return regions.groupBy("kind").agg(
        F.approx_count_distinct("text_len", 0.02).alias("lengths"), F.percentile_approx("confidence", 0.5, 1000).alias("middle"), F.percentile_approx("confidence", 0.95, 1000).alias("high")
    )


def sampled(regions: DataFrame, share: float = 0.1, seed: int = 7) -> DataFrame:
    """A random share of the regions of every kind, the same each time."""
    kinds = [r["kind"] for r in regions.select("kind").distinct().limit(64).collect()]
    return regions.stat.sampleBy("kind", {k: share for k in kinds}, seed)
