"""Matching the regions of two editions, what is accepted of it, and the issues of a page.

Matches are the optimal assignment of each page, gated by cost; then one source over several targets and
several sources in one target, in the order of the sources.  Issues are found in one pass over each
of pages, regions and matches: a row gives an array of findings, which is unrolled.
"""

from __future__ import annotations

from ..plans.relation import Operator, Relation
from . import grouped
from .regions import MAX_COST, MERGE_COST, PAIR_FLOOR, REGISTRATION_FLOOR, REVIEW_CONFIDENCE, SPLIT_OVERLAP, TEXT_FLOOR

#: The other engine has no assignment: its text finds the cheapest set of pairs over all sets of targets, source by source.
MATCHES = Operator(
    grouped.match_units,
    f"""
WITH RECURSIVE c AS MATERIALIZED (
  SELECT page, source, target, cost, overlap, dense_rank() OVER (PARTITION BY page ORDER BY source) - 1 AS i, dense_rank() OVER (PARTITION BY page ORDER BY target) - 1 AS j FROM {{costs}}
), d AS MATERIALIZED (SELECT page, max(i) + 1 AS n, max(j) + 1 AS m FROM c GROUP BY page),
best AS (
  SELECT page, 0::BIGINT AS i, 0::BIGINT AS mask, 0.0::DOUBLE AS total, []::BIGINT[] AS path FROM d
  UNION ALL
  SELECT page, i + 1, mask, min(total), arg_min(path, total) FROM (
    SELECT p.page, p.i, p.mask | (1::BIGINT << c.j::INT) AS mask, p.total + c.cost AS total, list_append(p.path, c.j) AS path FROM best p JOIN c ON c.page = p.page AND c.i = p.i WHERE (p.mask >> c.j::INT) & 1 = 0
    UNION ALL
    SELECT p.page, p.i, p.mask, p.total, list_append(p.path, -1::BIGINT) FROM best p JOIN d ON d.page = p.page WHERE p.i < d.n AND p.i - bit_count(p.mask) < d.n - d.m
  ) s GROUP BY page, i, mask
), ended AS (SELECT b.page, arg_min(b.path, b.total) AS path FROM best b JOIN d ON d.page = b.page AND b.i = d.n AND bit_count(b.mask) = least(d.n, d.m) GROUP BY b.page),
chosen AS (SELECT page, unnest(path) AS j, unnest(range(len(path))) AS i FROM ended),
ranked AS (SELECT page, i, j, source, target, cost, row_number() OVER w AS place, lead(cost) OVER w - cost AS margin FROM c WINDOW w AS (PARTITION BY page, i ORDER BY cost, j)),
one AS MATERIALIZED (
  SELECT c.page, c.i, c.j, c.source, c.target, c.cost,
    greatest(0.0, least(1.0, 1 - c.cost / {MAX_COST})) * greatest(0.45, least(1.0, 0.45 + coalesce(r.margin, 1.0) / 0.22)) AS confidence
  FROM chosen h JOIN c ON c.page = h.page AND c.i = h.i AND c.j = h.j JOIN ranked r ON r.page = h.page AND r.i = h.i AND r.place = 1 WHERE c.cost <= {MAX_COST}
), more AS (
  SELECT page, i, j, source, target, overlap FROM (
    SELECT c.*, row_number() OVER (PARTITION BY c.page, c.j ORDER BY c.i) AS turn FROM c JOIN one s ON s.page = c.page AND s.i = c.i
    WHERE c.overlap >= {SPLIT_OVERLAP} AND NOT EXISTS (SELECT 1 FROM one t WHERE t.page = c.page AND t.j = c.j)
  ) x WHERE turn = 1
), merged AS (
  SELECT r.page, r.i, r.j, r.source, r.target, r.cost FROM ranked r
  WHERE r.place = 1 AND r.cost <= {MERGE_COST} AND NOT EXISTS (SELECT 1 FROM one s WHERE s.page = r.page AND s.i = r.i)
    AND (EXISTS (SELECT 1 FROM one t WHERE t.page = r.page AND t.j = r.j) OR EXISTS (SELECT 1 FROM more t WHERE t.page = r.page AND t.j = r.j AND t.i < r.i))
), every AS (
  SELECT page, source, target, cost, confidence, 'one_to_one' AS relation FROM one
  UNION ALL SELECT page, source, target, 1 - overlap, least(0.55, overlap * 0.65), 'one_to_many' FROM more
  UNION ALL SELECT page, source, target, cost, 0.48, 'many_to_one' FROM merged
)
SELECT page, source, target, cost, confidence, relation, bool_or(relation <> 'one_to_one' OR confidence < {REVIEW_CONFIDENCE}) OVER (PARTITION BY page, source) AS ambiguous FROM every""",
)

ONE_TO_ONE = Relation("SELECT page, source, target, cost, confidence FROM {matches} m WHERE relation = 'one_to_one'")
SPLIT_OR_MERGED = Relation("SELECT page, source, target, relation, confidence FROM {matches} m WHERE relation <> 'one_to_one'")

_ART = "('sfx', 'free_text')"
_AUTO = "('speech', 'narration')"


def _array(*findings: tuple[str, str, str, str, str, str]) -> str:
    """SQL for the array of (unit, code, severity, value, threshold) of the conditions that hold."""
    rows = [f"CASE WHEN {when} THEN named_struct('unit', CAST({unit} AS BIGINT), 'code', '{code}', 'severity', '{severity}', 'value', CAST({value} AS DOUBLE), 'threshold', CAST({limit} AS DOUBLE)) END" for when, unit, code, severity, value, limit in findings]
    return f"array_compact(array({', '.join(rows)}))"


_PAGE_RULES = _array(
    (f"pair_confidence < {PAIR_FLOOR}", "NULL", "page_pair_low_confidence", "error", "pair_confidence", str(PAIR_FLOOR)),
    (f"registration_confidence < {REGISTRATION_FLOOR}", "NULL", "registration_low_confidence", "error", "registration_confidence", str(REGISTRATION_FLOOR)),
)
_READY = f"relation = 'one_to_one' AND confidence >= {REVIEW_CONFIDENCE}"
_MATCH_RULES = _array(
    (f"source_kind IN {_ART} OR target_kind IN {_ART}", "source", "art_text_review", "warning", "NULL", "NULL"),
    (f"confidence < {REVIEW_CONFIDENCE}", "source", "match_low_confidence", "error", "confidence", str(REVIEW_CONFIDENCE)),
    ("relation <> 'one_to_one'", "source", "split_merge_match", "error", "NULL", "NULL"),
    ("of_source > 1 AND source_turn = 1", "source", "source_mapped_multiple_times", "warning", "of_source", "NULL"),
    ("of_target > 1 AND target_turn = 1", "target", "target_receives_multiple_sources", "warning", "of_target", "NULL"),
    (f"{_READY} AND success IS NULL", "target", "lettering_missing", "error", "NULL", "NULL"),
    (f"{_READY} AND NOT success", "target", "lettering_failed", "error", "NULL", "NULL"),
    (f"{_READY} AND success AND coverage < 0.997", "target", "lettering_overflow", "error", "coverage", "0.997"),
    (f"{_READY} AND success AND font_size < 10", "target", "font_too_small", "warning", "font_size", "10"),
    # Not an issue: what passes the nine gates of automatic application.
    (f"pair_confidence >= {PAIR_FLOOR} AND registration_confidence >= {REGISTRATION_FLOOR} AND {_READY} AND source_confidence >= {TEXT_FLOOR} AND target_confidence >= {TEXT_FLOOR} AND source_kind IN {_AUTO} AND target_kind IN {_AUTO} AND text_len > 0",
     "source", "accepted", "accepted", "confidence", "target"),
)

_FINDINGS_OTHER = f"""
WITH p AS MATERIALIZED (SELECT * FROM {{pages}}), s AS MATERIALIZED (SELECT * FROM {{source}}), t AS MATERIALIZED (SELECT * FROM {{target}}), m AS MATERIALIZED (SELECT * FROM {{matches}}), l AS MATERIALIZED (SELECT * FROM {{lettering}}),
ready AS (SELECT m.*, l.success, l.coverage, l.font_size FROM m LEFT JOIN l ON l.page = m.page AND l.rid = m.target WHERE m.relation = 'one_to_one' AND m.confidence >= 0.60)
SELECT page, CAST(NULL AS BIGINT) AS unit, 'page_pair_low_confidence' AS code, 'error' AS severity, pair_confidence AS value, 0.45 AS threshold FROM p WHERE pair_confidence < 0.45
UNION ALL SELECT page, NULL, 'registration_low_confidence', 'error', registration_confidence, 0.55 FROM p WHERE registration_confidence < 0.55
UNION ALL SELECT page, rid, 'source_ocr_low_confidence', 'error', confidence, 0.66 FROM s WHERE confidence < 0.66
UNION ALL SELECT page, rid, 'target_detection_low_confidence', 'warning', confidence, 0.66 FROM t WHERE confidence < 0.66
UNION ALL SELECT m.page, m.source, 'art_text_review', 'warning', NULL, NULL FROM m WHERE EXISTS (SELECT 1 FROM s WHERE s.page = m.page AND s.rid = m.source AND s.kind IN ('sfx', 'free_text')) OR EXISTS (SELECT 1 FROM t WHERE t.page = m.page AND t.rid = m.target AND t.kind IN ('sfx', 'free_text'))
UNION ALL SELECT page, source, 'match_low_confidence', 'error', confidence, 0.60 FROM m WHERE confidence < 0.60
UNION ALL SELECT page, source, 'split_merge_match', 'error', NULL, NULL FROM m WHERE relation <> 'one_to_one'
UNION ALL SELECT page, source, 'source_mapped_multiple_times', 'warning', count(*), NULL FROM m GROUP BY page, source HAVING count(*) > 1
UNION ALL SELECT page, target, 'target_receives_multiple_sources', 'warning', count(*), NULL FROM m GROUP BY page, target HAVING count(*) > 1
UNION ALL SELECT page, rid, 'source_unmatched', 'error', NULL, NULL FROM s WHERE (page, rid) NOT IN (SELECT (page, source) FROM m)
UNION ALL SELECT page, target, 'lettering_missing', 'error', NULL, NULL FROM ready WHERE success IS NULL
UNION ALL SELECT page, target, 'lettering_failed', 'error', NULL, NULL FROM ready WHERE NOT success
UNION ALL SELECT page, target, 'lettering_overflow', 'error', coverage, 0.997 FROM ready WHERE success AND coverage < 0.997
UNION ALL SELECT page, target, 'font_too_small', 'warning', font_size, 10 FROM ready WHERE success AND font_size < 10
UNION ALL SELECT m.page, m.source, 'accepted', 'accepted', m.confidence, m.target FROM m JOIN p ON p.page = m.page JOIN s ON s.page = m.page AND s.rid = m.source JOIN t ON t.page = m.page AND t.rid = m.target
  WHERE p.pair_confidence >= 0.45 AND p.registration_confidence >= 0.55 AND m.relation = 'one_to_one' AND m.confidence >= 0.60 AND s.confidence >= 0.66 AND t.confidence >= 0.66 AND s.kind IN ('speech', 'narration') AND t.kind IN ('speech', 'narration') AND s.text_len > 0"""

#: Everything the rules say of a page: issues, and matches accepted (severity 'accepted').  Regions are read once with the matches, not once for each rule.
FINDINGS = Relation(f"""
WITH joined AS (
  SELECT s.page AS page, s.rid AS rid, s.kind AS source_kind, s.confidence AS source_confidence, s.text_len AS text_len, m.source AS source, m.target AS target, m.confidence AS confidence, m.relation AS relation,
    t.kind AS target_kind, t.confidence AS target_confidence, l.success AS success, l.coverage AS coverage, l.font_size AS font_size, p.pair_confidence AS pair_confidence, p.registration_confidence AS registration_confidence,
    count(m.source) OVER (PARTITION BY s.page, s.rid) AS of_source, row_number() OVER (PARTITION BY s.page, s.rid ORDER BY m.target) AS source_turn,
    count(m.target) OVER (PARTITION BY s.page, m.target) AS of_target, row_number() OVER (PARTITION BY s.page, m.target ORDER BY s.rid) AS target_turn
  FROM {{source}} s JOIN {{pages}} p ON p.page = s.page LEFT JOIN {{matches}} m ON m.page = s.page AND m.source = s.rid LEFT JOIN {{target}} t ON t.page = m.page AND t.rid = m.target LEFT JOIN {{lettering}} l ON l.page = m.page AND l.rid = m.target
)
SELECT page, f.unit AS unit, f.code AS code, f.severity AS severity, f.value AS value, f.threshold AS threshold FROM (
  SELECT page, explode({_PAGE_RULES}) AS f FROM {{pages}}
  UNION ALL SELECT page, explode(concat({_array(("confidence < 0.66", "rid", "target_detection_low_confidence", "warning", "confidence", "0.66"))})) FROM {{target}}
  UNION ALL SELECT page, explode(concat({_array(("source_turn = 1 AND source_confidence < 0.66", "rid", "source_ocr_low_confidence", "error", "source_confidence", "0.66"), ("source IS NULL", "rid", "source_unmatched", "error", "NULL", "NULL"))},
    CASE WHEN source IS NULL THEN array() ELSE {_MATCH_RULES} END)) FROM joined
) r""", _FINDINGS_OTHER)

ISSUES = Relation("SELECT page, unit, code, severity, value, threshold FROM {findings} f WHERE severity <> 'accepted'")

ACCEPTED = Relation("SELECT page, unit AS source, CAST(threshold AS BIGINT) AS target, value AS confidence FROM {findings} f WHERE severity = 'accepted'")

UNMATCHED = Relation("""
SELECT s.page AS page, 'source' AS side, s.rid AS rid FROM {source} s LEFT ANTI JOIN {matches} m ON m.page = s.page AND m.source = s.rid
UNION ALL
SELECT t.page, 'target', t.rid FROM {target} t LEFT ANTI JOIN {matches} m ON m.page = t.page AND m.target = t.rid""",
"""
SELECT s.page AS page, 'source' AS side, s.rid AS rid FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM {matches} m WHERE m.page = s.page AND m.source = s.rid)
UNION ALL
SELECT t.page, 'target', t.rid FROM {target} t WHERE NOT EXISTS (SELECT 1 FROM {matches} m WHERE m.page = t.page AND m.target = t.rid)""")  # fmt: skip

#: The three cheapest candidates of every source that is unmatched or ambiguous.
TOP_CANDIDATES = Relation("""
SELECT page, source, target, cost, place FROM (
  SELECT c.page AS page, c.source AS source, c.target AS target, c.cost AS cost, row_number() OVER (PARTITION BY c.page, c.source ORDER BY c.cost, c.target) AS place,
    count(m.source) OVER (PARTITION BY c.page, c.source) AS matched, count(CASE WHEN m.ambiguous THEN 1 END) OVER (PARTITION BY c.page, c.source) AS doubtful
  FROM {costs} c LEFT JOIN (SELECT page, source, bool_or(ambiguous) AS ambiguous FROM {matches} GROUP BY page, source) m ON m.page = c.page AND m.source = c.source
) r WHERE place <= 3 AND (matched = 0 OR doubtful > 0)""")

#: A page's matches, acceptance and issues.
MATCH_SUMMARY = Relation("""
SELECT p.page AS page, p.pair_confidence AS pair_confidence, p.registration_confidence AS registration_confidence, coalesce(f.accepted, 0) AS accepted, coalesce(f.mean_confidence, 0.0) AS mean_confidence,
  coalesce(f.errors, 0) AS errors, coalesce(f.warnings, 0) AS warnings, coalesce(f.errors, 0) = 0 AS passed
FROM {pages} p LEFT JOIN (
  SELECT page, count(CASE WHEN severity = 'accepted' THEN 1 END) AS accepted, round(avg(CASE WHEN severity = 'accepted' THEN value END), 9) AS mean_confidence, count(CASE WHEN severity = 'error' THEN 1 END) AS errors, count(CASE WHEN severity = 'warning' THEN 1 END) AS warnings
  FROM {findings} GROUP BY page) f ON f.page = p.page""")
