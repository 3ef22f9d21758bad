"""Matching, spatial and gate operators over region rows (page, rid, box, kind, confidence, text_len, ord, n)."""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.relation import Relation

#: Weights of the pair cost and thresholds of matching (fixed values).
CENTRE_W, OVERLAP_W, IOU_W, LENGTH_W, SHAPE_W, ORDER_W, KIND_W = 0.34, 0.28, 0.10, 0.08, 0.10, 0.06, 0.04
REGISTRATION_W, OVERLAP_GATE, OVERLAP_BONUS, MAX_COST, REVIEW_CONFIDENCE, MERGE_COST, SPLIT_OVERLAP = 0.12, 0.30, 0.05, 0.74, 0.60, 0.60, 0.58
PAIR_FLOOR, REGISTRATION_FLOOR, TEXT_FLOOR = 0.45, 0.55, 0.66
#: The size of a page of the derived tables.
PAGE_W, PAGE_H = 800.0, 1100.0

_length_cost = "(CASE WHEN s.text_len <= 1 OR t.text_len <= 1 THEN 0.0 ELSE least(1.0, abs(ln(s.text_len / t.text_len)) / 2) END)"
_aspect = lambda p: f"greatest(0.0001, ({p}x1 - {p}x0) / greatest(1.0, {p}y1 - {p}y0))"
_shape_cost = f"(0.55 * least(1.0, abs(ln(greatest(1.0, {g.area('s.')}) / greatest(1.0, {g.area('t.')}))) / 2) + 0.45 * least(1.0, abs(ln({_aspect('s.')} / {_aspect('t.')})) / 2))"
_kind_cost = "(CASE WHEN s.kind = t.kind THEN 0.0 WHEN s.kind IN ('speech', 'narration') AND t.kind IN ('speech', 'narration') THEN 0.3 WHEN s.kind = 'unknown' OR t.kind = 'unknown' THEN 0.2 ELSE 0.85 END)"
_rank = lambda p: f"CAST({p}ord AS DOUBLE) / greatest({p}n - 1, 1)"

#: All pairs of a page with their overlaps.  Pages are small; the join is by page, never across pages.
PAIRS = Relation(f"""
SELECT s.page AS page, s.rid AS source, t.rid AS target, {g.iou('s.', 't.')} AS iou, {g.over_smaller('s.', 't.')} AS overlap, {g.over_smaller_floored('s.', 't.')} AS overlap_px,
  {g.over_first('s.', 't.')} AS covered, {g.gap('s.', 't.')} AS gap, {g.centre_distance('s.', 't.', str((PAGE_W**2 + PAGE_H**2) ** 0.5))} AS distance
FROM {{source}} s JOIN {{target}} t ON s.page = t.page""")

#: The cost of every pair, from seven weighted terms and the page's registration.
COSTS = Relation(f"""
SELECT page, source, target, overlap, iou, CASE WHEN overlap >= {OVERLAP_GATE} THEN greatest(0.0, raw - {OVERLAP_BONUS}) ELSE raw END AS cost
FROM (
  SELECT s.page AS page, s.rid AS source, t.rid AS target, {g.over_smaller('s.', 't.')} AS overlap, {g.iou('s.', 't.')} AS iou,
    {CENTRE_W} * least(1.0, {g.centre_distance('s.', 't.', str((PAGE_W**2 + PAGE_H**2) ** 0.5))} * 4) + {OVERLAP_W} * (1 - {g.over_smaller('s.', 't.')}) + {IOU_W} * (1 - {g.iou('s.', 't.')})
      + {LENGTH_W} * {_length_cost} + {SHAPE_W} * {_shape_cost} + {ORDER_W} * least(1.0, abs({_rank('s.')} - {_rank('t.')}) * 2) + {KIND_W} * {_kind_cost}
      + {REGISTRATION_W} * (1 - greatest(0.0, least(1.0, p.registration_confidence))) AS raw
  FROM {{source}} s JOIN {{target}} t ON s.page = t.page JOIN {{pages}} p ON p.page = s.page
) c""")

#: The best candidate of each source region, its margin over the second and the confidence they give.
BEST = Relation(f"""
SELECT page, source, target, cost, margin, greatest(0.0, least(1.0, 1 - cost / {MAX_COST})) * greatest(0.45, least(1.0, 0.45 + margin / 0.22)) AS confidence
FROM (
  SELECT page, source, target, cost, coalesce(lead(cost) OVER (PARTITION BY page, source ORDER BY cost, target) - cost, 1.0) AS margin, row_number() OVER (PARTITION BY page, source ORDER BY cost, target) AS place
  FROM {{costs}}
) r WHERE place = 1""")

TOP3 = Relation("""
SELECT page, source, target, cost, place FROM (
  SELECT page, source, target, cost, row_number() OVER (PARTITION BY page, source ORDER BY cost, target) AS place FROM {costs}
) r WHERE place <= 3""")

#: Targets given to the cheapest of the sources they are the best candidate of: what needs no optimiser.
MUTUAL = Relation(f"""
SELECT page, source, target, cost, confidence
FROM (
  SELECT b.page, b.source, b.target, b.cost, b.confidence, row_number() OVER (PARTITION BY b.page, b.target ORDER BY b.cost, b.source) AS turn FROM {{best}} b WHERE b.cost <= {MAX_COST}
) m WHERE turn = 1""")

#: Each block (its centre) to the region that holds it, the first of several; its kind follows where it is unknown.
ASSIGNED = Relation(f"""
SELECT page, block, region, CASE WHEN block_kind <> 'unknown' THEN block_kind WHEN region IS NULL THEN 'free_text' ELSE region_kind END AS kind
FROM (
  SELECT t.page AS page, t.rid AS block, t.kind AS block_kind, s.rid AS region, s.kind AS region_kind, row_number() OVER (PARTITION BY t.page, t.rid ORDER BY s.rid) AS turn
  FROM {{blocks}} t LEFT JOIN {{regions}} s ON s.page = t.page AND {g.holds('s.', *g.centre('t.'))}
) a WHERE turn = 1""")

#: Regions of the second edition with no partner that overlaps enough.
UNCOVERED = Relation(f"""
SELECT t.page AS page, t.rid AS rid, t.confidence AS confidence FROM {{target}} t LEFT ANTI JOIN {{source}} s ON s.page = t.page AND {g.over_smaller('s.', 't.')} >= 0.45 WHERE t.confidence >= 0.70""",
f"""
SELECT t.page AS page, t.rid AS rid, t.confidence AS confidence FROM {{target}} t WHERE t.confidence >= 0.70 AND NOT EXISTS (SELECT 1 FROM {{source}} s WHERE s.page = t.page AND {g.over_smaller('s.', 't.')} >= 0.45)""")  # fmt: skip

#: Blocks in a query region: centre inside, or at least 0.30 of the block; in reading order.
RANGE_QUERY = Relation(f"""
SELECT s.page AS page, s.rid AS region, t.rid AS block, row_number() OVER (PARTITION BY s.page, s.rid ORDER BY t.ord, t.y0, t.x0) - 1 AS place
FROM {{regions}} s JOIN {{blocks}} t ON s.page = t.page WHERE {g.holds('s.', *g.centre('t.'))} OR {g.over_first('t.', 's.')} >= 0.30""")

#: The stricter query of region binding: centre inside and 0.45 of the block, or 0.82 of it.
BINDING_QUERY = Relation(f"""
SELECT s.page AS page, s.rid AS region, t.rid AS block
FROM {{regions}} s JOIN {{blocks}} t ON s.page = t.page WHERE ({g.holds('s.', *g.centre('t.'))} AND {g.over_first('t.', 's.')} >= 0.45) OR {g.over_first('t.', 's.')} >= 0.82""")

#: ALLOW, PROTECT or UNKNOWN for every region from its largest overlaps with layout items by label.
AUTHORITY = Relation(f"""
SELECT page, rid, kind, bubble, text, sfx, panel,
  CASE WHEN supported THEN 'ALLOW' WHEN panel >= 0.20 THEN 'PROTECT' ELSE 'UNKNOWN' END AS state,
  CASE WHEN supported THEN 'layout_support' WHEN panel >= 0.20 THEN 'panel_only' ELSE 'no_support' END AS reason
FROM (
  SELECT *, CASE WHEN kind IN ('complex_text', 'free_text', 'text', 'sfx', 'onomatopoeia') THEN text >= 0.35 OR sfx >= 0.35
    WHEN kind IN ('bubble', 'speech', 'narration', 'container') THEN bubble >= 0.25 OR text >= 0.35 ELSE bubble >= 0.25 OR text >= 0.35 OR sfx >= 0.35 END AS supported
  FROM (
    SELECT s.page AS page, s.rid AS rid, s.kind AS kind,
      coalesce(max(CASE WHEN t.kind = 'speech' THEN {g.over_smaller('s.', 't.')} END), 0.0) AS bubble, coalesce(max(CASE WHEN t.kind = 'narration' THEN {g.over_smaller('s.', 't.')} END), 0.0) AS text,
      coalesce(max(CASE WHEN t.kind = 'sfx' THEN {g.over_smaller('s.', 't.')} END), 0.0) AS sfx, coalesce(max(CASE WHEN t.kind = 'unknown' THEN {g.over_smaller('s.', 't.')} END), 0.0) AS panel
    FROM {{regions}} s LEFT JOIN {{items}} t ON t.page = s.page GROUP BY s.page, s.rid, s.kind
  ) o
) d""")

#: KEEP, DROP or REVIEW by the overlap with ignored, processed and reviewed layout.
CANDIDATE_DECISION = Relation("""
SELECT page, rid, CASE WHEN ignored >= 0.20 AND processed < 0.12 THEN 'DROP' WHEN processed >= 0.06 THEN 'KEEP' WHEN strategy = 'strict' THEN 'DROP' WHEN reviewed >= 0.08 THEN 'REVIEW' ELSE 'KEEP' END AS decision,
  CASE WHEN ignored >= 0.20 AND processed < 0.12 THEN 'ignore_overlap' WHEN processed >= 0.06 THEN 'process_support' WHEN strategy = 'strict' THEN 'strict_without_support' WHEN reviewed >= 0.08 THEN 'review_support' ELSE 'neutral' END AS reason
FROM (SELECT page, rid, sfx AS ignored, bubble AS processed, text AS reviewed, CASE WHEN page % 2 = 0 THEN 'strict' ELSE 'auto' END AS strategy FROM {authority}) o""")

#: Neutral white regions that no existing region represents.
WHITE_COMPLETION = Relation(f"""
SELECT t.page AS page, t.rid AS rid
FROM (SELECT page, rid, x0, y0, x1, y1, confidence AS white, 1 - confidence AS dark, text_len AS sat_median, text_len * 2 - 4 AS sat_p75, rid % 3 = 0 AS colored FROM {{target}}) t
LEFT ANTI JOIN {{existing}} s ON s.page = t.page AND {g.over_smaller_floored('s.', 't.')} >= 0.28
WHERE t.white >= 0.55 AND t.dark <= 0.28 AND t.sat_median <= 12 AND t.sat_p75 <= 24 AND NOT t.colored""",
f"""
SELECT t.page AS page, t.rid AS rid
FROM (SELECT page, rid, x0, y0, x1, y1, confidence AS white, 1 - confidence AS dark, text_len AS sat_median, text_len * 2 - 4 AS sat_p75, rid % 3 = 0 AS colored FROM {{target}}) t
WHERE t.white >= 0.55 AND t.dark <= 0.28 AND t.sat_median <= 12 AND t.sat_p75 <= 24 AND NOT t.colored AND NOT EXISTS (SELECT 1 FROM {{existing}} s WHERE s.page = t.page AND {g.over_smaller_floored('s.', 't.')} >= 0.28)""")  # fmt: skip

_aspect5 = "greatest((t.x1 - t.x0) / greatest(1.0, t.y1 - t.y0), (t.y1 - t.y0) / greatest(1.0, t.x1 - t.x0)) <= 5"
_touches = f"({g.intersection('t.', 's.')} > 0 OR {g.holds('t.', 'floor((s.x0 + s.x1) / 2)', 'floor((s.y0 + s.y1) / 2)')})"
#: Regions of ordinary shape, and others that touch a region under review.
REVIEW_COMPLETION = Relation(f"""
SELECT page, rid FROM {{target}} t WHERE {_aspect5}
UNION ALL
SELECT t.page AS page, t.rid AS rid FROM {{target}} t LEFT SEMI JOIN {{review}} s ON s.page = t.page AND {_touches} WHERE NOT {_aspect5}""",
f"""
SELECT page, rid FROM {{target}} t WHERE {_aspect5} OR EXISTS (SELECT 1 FROM {{review}} s WHERE s.page = t.page AND {_touches})""")  # fmt: skip

#: The same overlap join through a grid of cells: each box is listed in the cells it covers, so no pair far apart is compared.
GRID_PAIRS = Relation(f"""
WITH a AS (SELECT *, explode(sequence(CAST(floor(y0 / 128) AS INT), CAST(floor(y1 / 128) AS INT))) AS cell FROM {{source}}),
b AS (SELECT *, explode(sequence(CAST(floor(y0 / 128) AS INT), CAST(floor(y1 / 128) AS INT))) AS cell FROM {{target}})
SELECT s.page AS page, s.rid AS source, t.rid AS target, {g.iou('s.', 't.')} AS iou FROM a s JOIN b t ON s.page = t.page AND s.cell = t.cell
WHERE {g.intersection('s.', 't.')} > 0 AND s.cell = CAST(floor(greatest(s.y0, t.y0) / 128) AS INT)""",
f"""
SELECT s.page AS page, s.rid AS source, t.rid AS target, {g.iou('s.', 't.')} AS iou FROM {{source}} s JOIN {{target}} t ON s.page = t.page WHERE {g.intersection('s.', 't.')} > 0""")  # fmt: skip

#: Columns of text from right to left, or lines in bands of 0.7 median heights, half bands rounded to even.
READING_ORDER = Relation("""
SELECT b.page AS page, b.rid AS rid, row_number() OVER (PARTITION BY b.page ORDER BY -(b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2, b.rid) - 1 AS vertical,
  row_number() OVER (PARTITION BY b.page ORDER BY rint((b.y0 + b.y1) / 2 / greatest(1.0, 0.7 * m.height)), (b.x0 + b.x1) / 2, b.rid) - 1 AS horizontal
FROM {regions} b JOIN (SELECT page, median(y1 - y0) AS height FROM {regions} GROUP BY page) m ON m.page = b.page""",
"""
SELECT b.page AS page, b.rid AS rid, row_number() OVER (PARTITION BY b.page ORDER BY -(b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2, b.rid) - 1 AS vertical,
  row_number() OVER (PARTITION BY b.page ORDER BY round_even((b.y0 + b.y1) / 2 / greatest(1.0, 0.7 * m.height), 0), (b.x0 + b.x1) / 2, b.rid) - 1 AS horizontal
FROM {regions} b JOIN (SELECT page, median(y1 - y0) AS height FROM {regions} GROUP BY page) m ON m.page = b.page""")  # fmt: skip

#: Nearest anchor of every region: the first three regions of a page are its anchors.
NEAREST_ANCHOR = Relation("""
SELECT page, rid, anchor FROM (
  SELECT s.page AS page, s.rid AS rid, t.rid AS anchor, row_number() OVER (PARTITION BY s.page, s.rid ORDER BY (s.x0 - t.x0) * (s.x0 - t.x0) + (s.y0 - t.y0) * (s.y0 - t.y0), t.rid) AS turn
  FROM {regions} s JOIN {regions} t ON s.page = t.page WHERE t.rid <= 3
) d WHERE turn = 1""")

#: Headers and footers by place, width and height.
FURNITURE = Relation(f"""
SELECT page, rid, (y1 <= {0.14 * PAGE_H} AND y1 - y0 <= {0.060 * PAGE_H} AND (x1 - x0) >= 1.65 * (y1 - y0) AND ((x0 + x1) / 2 <= {0.34 * PAGE_W} OR (x0 + x1) / 2 >= {0.66 * PAGE_W}))
  OR (y0 >= {0.94 * PAGE_H} AND y1 - y0 <= {0.035 * PAGE_H}) AS furniture FROM {{regions}}""")

#: Pairing by ids: a region's own id, then its partner's, then what only the target side knows; each target is used once.
PAIRED_IDS = Relation("""
WITH first AS (
  SELECT s.page AS page, s.rid AS source, t.rid AS target, row_number() OVER (PARTITION BY s.page, t.rid ORDER BY s.rid) AS turn
  FROM {source} s JOIN {target} t ON t.page = s.page AND t.rid = s.rid + s.rid % 2
), direct AS (SELECT page, source, target FROM first WHERE turn = 1),
back AS (
  SELECT t.page AS page, s.rid AS source, t.rid AS target, row_number() OVER (PARTITION BY t.page, s.rid ORDER BY t.rid) AS turn
  FROM {target} t JOIN {source} s ON s.page = t.page AND s.rid = t.rid LEFT JOIN direct d ON d.page = t.page AND d.target = t.rid LEFT JOIN direct e ON e.page = t.page AND e.source = s.rid
  WHERE d.page IS NULL AND e.page IS NULL
)
SELECT m.page AS page, m.source AS source, m.target AS target, m.route AS route, greatest(0.60, least(0.995, 0.86 + 0.12 * greatest(0.0, least(1.0, p.registration_confidence)))) AS confidence
FROM (SELECT page, source, target, 'direct' AS route FROM direct UNION ALL SELECT page, source, target, 'reciprocal' FROM back WHERE turn = 1) m JOIN {pages} p ON p.page = m.page""")
