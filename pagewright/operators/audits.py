"""Audits of transfers and workspaces: the issues of records, pages, coverage and files."""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.relation import Relation, Rules

#: Bounds of transferred regions: least overlap, least coverage, most spill; of photographed pages; and what a rigid patch may have (fixed values).
BOUNDS, PHOTO_BOUNDS, PATCH_BOUNDS = (0.80, 0.985, 0.04), (0.74, 0.84, 0.27), (0.92, 0.10)
PAIR_FLOOR, REGISTRATION_FLOOR, TEXT_FLOOR, UPSCALE_LIMIT, SHARP_FLOOR = 0.45, 0.55, 0.66, 3.25, 18.0
CLIPPED = "source_text_region_clipped_at_page_edge"
STRICT_ROUTES = "('photo_pair', 'free_text', 'complex_text', 'ocr_guided_components')"

_photo = "geometry_mode = 'photo_pair'"
_patch = "geometry_mode = 'rigid_uniform_container' AND clarity_mode = 'locked-source-container-patch'"


def _bound(k: int) -> str:
    plain = f"CASE WHEN {_photo} THEN {PHOTO_BOUNDS[k]} ELSE {BOUNDS[k]} END"
    if k == 0:
        return f"({plain})"
    pick, limit = (("least", PATCH_BOUNDS[0]), ("greatest", PATCH_BOUNDS[1]))[k - 1]
    return f"(CASE WHEN {_patch} THEN {pick}({plain}, {limit}) ELSE {plain} END)"


def record_rules(prefix: str = "mask_replace", safety: bool = False, fidelity: str = "auto") -> Rules:
    """The rules of transfer records (with ``has_units``: the page has recognised source units).

    ``safety``: publication is guarded, so what is a warning else is an error.  A record that was not applied has one
    issue; one held back as a candidate has none of the geometry's.
    """
    guarded = "'error'" if safety else "'warning'"
    guess = "(NOT has_units AND geometry_mode = 'complex_text' AND source_id LIKE 'diff-src-%')"
    held = "(candidate OR review_required)"
    free = f"applied AND NOT {held}"
    mild = f"CASE WHEN {guess} OR (review_reason = '{CLIPPED}' AND target_coverage >= 0.98) OR ({_patch}) OR clarity_mode IN ('complex-text-ink-transfer', 'open-text-ink-transfer') THEN 'warning' ELSE 'error' END"
    code = lambda name: f"{prefix}_{name}"
    none = ("NULL", "NULL")
    return Rules(
        ("page", "rid"),
        [
            (f"NOT applied AND coalesce(reason, '') = '{CLIPPED}'", code("source_translation_clipped"), "'error'", *none),
            (f"NOT applied AND coalesce(reason, '') <> '{CLIPPED}'", code("rejected"), f"CASE WHEN {guess} THEN 'warning' ELSE 'error' END", *none),
            ("applied AND content_check LIKE 'checked%' AND NOT content_complete", code("content_incomplete"), "'warning'", *none),
            ("applied AND content_check NOT LIKE 'checked%' AND content_check <> 'disabled'", code("content_unverified"), f"CASE WHEN geometry_mode IN {STRICT_ROUTES} THEN {guarded} ELSE 'warning' END", *none),
            (f"applied AND {held}", code("low_confidence_candidate"), mild if safety else "'warning'", *none),
            (f"{free} AND mask_iou < {_bound(0)}", code("low_iou"), guarded, "mask_iou", _bound(0)),
            (f"{free} AND target_coverage < {_bound(1)}", code("low_coverage"), guarded, "target_coverage", _bound(1)),
            (f"{free} AND spill_ratio > {_bound(2)}", code("spill"), guarded, "spill_ratio", _bound(2)),
            (f"{free} AND integrity_contract AND glyph_dense_warp", code("dense_glyph_warp_forbidden"), "'error'", *none),
            (f"{free} AND sr_scale > {UPSCALE_LIMIT}", code("high_upscale"), "'warning'", "sr_scale", str(UPSCALE_LIMIT)),
            (f"{free} AND sharpness > 0 AND sharpness < {SHARP_FLOOR}", code("low_sharpness"), "'warning'", "sharpness", str(SHARP_FLOOR)),
            (f"{free} AND clarity_mode = 'ink-reconstruction' AND NOT ({_photo}) AND '{fidelity}' <> 'ink'", code("source_raster_fidelity_regression"), "'error'", *none),
            (f"{free} AND clarity_mode = 'ink-reconstruction' AND (({_photo}) OR '{fidelity}' = 'ink')", code("ink_reconstruction"), "'info'", *none),
            (f"{free} AND clarity_mode = 'photo-crisp-ink'", code("photo_crisp_ink"), "'info'", *none),
        ],
    )


#: What a direct transfer may not do: put the source below, keep its border, turn a locked axis, shift text.
CONTRACT_RULES = Rules(
    ("page", "rid"),
    [
        ("has_contract AND NOT source_on_top", "direct_patch_source_layer_order_violation", "'error'", "NULL", "NULL"),
        ("has_contract AND NOT border_removed", "direct_patch_source_border_violation", "'error'", "NULL", "NULL"),
        ("has_contract AND axis_locked AND abs(rotation_deg) > 0.000001", "direct_patch_rotation_violation", "'error'", "abs(rotation_deg)", "0"),
        ("has_contract AND (shift_dx <> 0 OR shift_dy <> 0)", "direct_patch_text_shift_violation", "'error'", "NULL", "NULL"),
    ],
)


def _page_rules(prefix: str, safety: bool) -> Rules:
    guarded = "'error'" if safety else "'warning'"
    verified = f"(photo_records > 0 AND photo_unexplained = 0 AND photo_applied > 0 AND registration_confidence >= {max(REGISTRATION_FLOOR, 0.82)})"
    return Rules(
        ("page", "CAST(NULL AS BIGINT) AS rid"),
        [
            (f"pair_confidence < {PAIR_FLOOR}", "page_pair_low_confidence", f"CASE WHEN {verified} THEN 'warning' ELSE {guarded} END", "pair_confidence", str(PAIR_FLOOR)),
            (f"registration_confidence < {REGISTRATION_FLOOR}", "registration_low_confidence", guarded, "registration_confidence", str(REGISTRATION_FLOOR)),
            ("eligible = 0 AND records = 0", f"{prefix}_no_candidates", "'error'", "NULL", "NULL"),
        ],
    )


_PAGES = """(SELECT p.page AS page, p.pair_confidence AS pair_confidence, p.registration_confidence AS registration_confidence, coalesce(r.records, 0) AS records, coalesce(r.photo_records, 0) AS photo_records,
  coalesce(r.photo_applied, 0) AS photo_applied, coalesce(r.photo_unexplained, 0) AS photo_unexplained, coalesce(b.eligible, 0) AS eligible
FROM {pages} p LEFT JOIN (SELECT page, count(*) AS records, count(CASE WHEN geometry_mode = 'photo_pair' THEN 1 END) AS photo_records, count(CASE WHEN geometry_mode = 'photo_pair' AND applied THEN 1 END) AS photo_applied,
    count(CASE WHEN geometry_mode = 'photo_pair' AND NOT applied AND coalesce(reason, '') <> '""" + CLIPPED + """' THEN 1 END) AS photo_unexplained FROM {records} GROUP BY page) r ON r.page = p.page
  LEFT JOIN (SELECT page, count(*) AS eligible FROM {bubbles} WHERE kind IN ('speech', 'narration') AND text_len > 0 GROUP BY page) b ON b.page = p.page) w"""
_RECORDS = "(SELECT r.*, u.page IS NOT NULL AS has_units FROM {records} r LEFT JOIN (SELECT DISTINCT page FROM {units}) u ON u.page = r.page) v"
_UNMATCHED = "SELECT b.page AS page, b.rid AS rid, 'source_bubble_unmatched' AS code, 'error' AS severity, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold FROM {bubbles} b LEFT JOIN {records} r ON r.page = b.page AND r.rid = b.rid WHERE b.kind IN ('speech', 'narration') AND b.text_len > 0 AND r.page IS NULL"
_DOUBTFUL = f"SELECT page, rid, 'source_ocr_low_confidence' AS code, 'warning' AS severity, confidence AS value, CAST({TEXT_FLOOR} AS DOUBLE) AS threshold FROM {{units}} u WHERE confidence < {TEXT_FLOOR}"


def transfer_issues(prefix: str = "mask_replace", contract: bool = False, safety: bool = False, fidelity: str = "auto") -> Relation:
    """The issues of a page's transfer: pages, records, source units and source bubbles; with ``contract`` those of a direct one too."""
    rules, pages = record_rules(prefix, safety, fidelity), _page_rules(prefix, safety)
    here = [pages.here(_PAGES), _DOUBTFUL, _UNMATCHED, rules.here(_RECORDS)] + ([CONTRACT_RULES.here("{records}")] if contract else [])
    there = [pages.there(_PAGES), _DOUBTFUL, _UNMATCHED, rules.there(_RECORDS)] + ([CONTRACT_RULES.there("{records}")] if contract else [])
    return Relation(" UNION ALL ".join(here), " UNION ALL ".join(there))


MASK_ISSUES, DIRECT_ISSUES = transfer_issues(), transfer_issues("direct_patch", contract=True)
GUARDED_ISSUES = transfer_issues(safety=True, fidelity="ink")

#: Bounds of the clear mask and of what may stay dark in it.
CLEAR_ISSUES = Relation("""
SELECT page, CAST(NULL AS BIGINT) AS rid, 'mask_heavily_clipped' AS code, 'warning' AS severity, clipped_ratio AS value, CAST(0.18 AS DOUBLE) AS threshold FROM {clear} c WHERE source_pixels > 0 AND clipped_ratio > 0.18
UNION ALL SELECT page, rid, 'possible_japanese_residual', 'warning', dark_ratio, CAST(0.06 AS DOUBLE) FROM {residual} r WHERE dark_ratio > 0.06""")

#: Strong bubbles with text in them, and strong text of its own, that no applied record covers.  Coverage is the largest share of the box that one record covers.
COVERAGE_ISSUES = Relation(f"""
WITH covered AS (
  SELECT i.page AS page, i.rid AS rid, i.label AS label, i.confidence AS confidence, i.x0 AS x0, i.y0 AS y0, i.x1 AS x1, i.y1 AS y1, coalesce(max({g.over_first('i.', 'r.')}), 0.0) AS coverage
  FROM {{items}} i LEFT JOIN (SELECT * FROM {{records}} a WHERE applied) r ON r.page = i.page WHERE (i.label = 'bubble' AND i.confidence >= 0.70) OR (i.label = 'text' AND i.confidence >= 0.75)
  GROUP BY i.page, i.rid, i.label, i.confidence, i.x0, i.y0, i.x1, i.y1
), inside AS (
  SELECT b.page AS page, b.rid AS bubble, t.rid AS text, {g.over_first('t.', 'b.')} AS share FROM covered b JOIN covered t ON t.page = b.page AND b.label = 'bubble' AND t.label = 'text'
), bubbles AS (SELECT page, bubble FROM inside WHERE share >= 0.35 GROUP BY page, bubble), texts AS (SELECT page, text FROM inside WHERE share >= 0.55 GROUP BY page, text)
SELECT c.page AS page, c.rid AS rid, 'koharu_semantic_uncovered_bubble' AS code, CASE WHEN c.confidence >= 0.85 THEN 'error' ELSE 'warning' END AS severity, c.confidence AS value, CAST(0.70 AS DOUBLE) AS threshold
FROM covered c JOIN bubbles b ON b.page = c.page AND b.bubble = c.rid WHERE c.label = 'bubble' AND c.coverage < 0.08
UNION ALL
SELECT c.page, c.rid, 'koharu_semantic_uncovered_text', 'warning', c.confidence, CAST(0.75 AS DOUBLE)
FROM covered c LEFT JOIN texts t ON t.page = c.page AND t.text = c.rid WHERE c.label = 'text' AND c.coverage < 0.12 AND t.page IS NULL""")

#: A photographed pair without recognised text on either side: by contract, or because evidence is missing.
PHOTO_ISSUES = Relation("""
SELECT p.page AS page, CASE WHEN p.mode = 'mask_replace' THEN 'photo_pair_visual_only_contract' ELSE 'photo_pair_ocr_evidence_missing' END AS code,
  CASE WHEN p.mode = 'mask_replace' THEN 'warning' WHEN coalesce(r.photo, 0) > 0 AND r.photo = r.photo_applied AND p.registration_confidence >= 0.78 THEN 'warning' ELSE 'error' END AS severity,
  coalesce(r.records, 0) AS detected_regions, coalesce(r.records > 0 AND r.unverified = 0, false) AS content_verified
FROM {photo_pages} p LEFT JOIN (
  SELECT page, count(*) AS records, count(CASE WHEN geometry_mode IN ('photo_pair', 'rigid_uniform_container') OR backend = 'rigid-container-raster' THEN 1 END) AS photo,
    count(CASE WHEN (geometry_mode IN ('photo_pair', 'rigid_uniform_container') OR backend = 'rigid-container-raster') AND applied THEN 1 END) AS photo_applied,
    count(CASE WHEN applied AND NOT (content_check LIKE 'checked%' AND content_complete) THEN 1 END) AS unverified FROM {records} GROUP BY page) r ON r.page = p.page
WHERE p.method = 'photo_pair' AND p.source_blocks = 0 AND p.target_blocks = 0""")

#: Files of a page that only a rendering route may leave (fixed values).
PASSTHROUGH_FORBIDDEN = (
    "transfer_audit.json", "clear_mask.png", "target_clear_mask.png", "text_layer.png", "chinese_transfer_layer.png", "review_preview.png", "hybrid_transfer_layer.png", "hybrid_transfer_mask.png", "hybrid_text_layer.png",
    "reletter_text_layer.png", "replace_translation",
)
#: Files that modes own (fixed values).
OWNED = {
    "direct_patch": ("direct_patch_layer.png", "direct_patch_layer_reviewed.png", "direct_patch_regions.png", "direct_patch.json"),
    "mask_replace": ("mask_transfer_layer.png", "mask_transfer_layer_reviewed.png", "mask_transfer_mask.png", "mask_transfer.json"),
    "hybrid": ("hybrid_transfer_layer.png", "hybrid_transfer_layer_reviewed.png", "hybrid_transfer_mask.png", "hybrid_transfer.json", "hybrid_text_layer.png", "hybrid_text_layer_reviewed.png"),
    "reletter": ("reletter_text_layer.png", "reletter_text_layer_reviewed.png", "reletter.json"),
    "transparent_bubble_reveal": ("transparent_bubble_reveal.json", "final_rgba.png", "jp_layer_rgba.png", "cn_layer_rgb.png"),
    "aligned_overlay_reveal": ("aligned_overlay_reveal.json", "aligned_overlay_reveal_layer.png", "aligned_overlay_reveal_mask.png", "aligned_overlay_reveal_hole_mask.png", "aligned_overlay_reveal_erase_mask.png", "aligned_overlay_reveal_regions.png", "aligned_overlay_reveal_source_ink.png"),
}
OWNER_ROWS = "(SELECT * FROM (VALUES " + ", ".join(f"('{owner}', '{name}')" for owner, names in OWNED.items() for name in names) + ") AS v(owner, name))"
#: The owners a mode may leave files of: its own; the old automatic mode those of the strategy it chose.
ALLOWED_OWNER = "CASE WHEN m.mode = 'auto' THEN CASE WHEN m.strategy IN ('direct_patch', 'aligned_overlay_reveal') THEN m.strategy ELSE 'mask_replace' END ELSE m.mode END"

#: Files of each owner that a page has.
OWNERSHIP = Relation(f"SELECT f.page AS page, o.owner AS owner, count(*) AS files, min(f.name) AS first_name FROM {{files}} f JOIN {OWNER_ROWS} o ON o.name = f.name GROUP BY f.page, o.owner")

LEAKS = Relation(f"SELECT f.page AS page, concat(o.owner, ':', f.name) AS violation FROM {{files}} f JOIN {OWNER_ROWS} o ON o.name = f.name JOIN {{runs}} m ON m.page = f.page WHERE o.owner <> {ALLOWED_OWNER}")

#: The schema of receipts that runs of this library write.
RECEIPT_SCHEMA = "pagewright.run_receipt.v1"
RECEIPT_RULES = Rules(
    ("page", "'run_receipt.json' AS name"),
    [
        ("receipt IS NULL", "missing_run_receipt", "'error'", "NULL", "NULL"),
        ("receipt = 'broken'", "invalid_run_receipt", "'error'", "NULL", "NULL"),
        (f"receipt = 'read' AND coalesce(receipt_schema, '') <> '{RECEIPT_SCHEMA}'", "run_receipt_schema", "'error'", "NULL", "NULL"),
        ("receipt = 'read' AND lower(trim(coalesce(receipt_mode, ''))) <> mode", "run_receipt_mode_mismatch", "'error'", "NULL", "NULL"),
        ("receipt = 'read' AND lower(trim(coalesce(receipt_project_mode, ''))) NOT IN ('', mode)", "run_receipt_project_mode_mismatch", "'error'", "NULL", "NULL"),
        ("receipt = 'read' AND strategy <> '' AND lower(trim(coalesce(receipt_strategy, ''))) NOT IN ('', strategy)", "run_receipt_strategy_mismatch", "'error'", "NULL", "NULL"),
        ("receipt = 'read' AND NOT coalesce(receipt_passed, true)", "run_receipt_mode_execution_failed", "'error'", "NULL", "NULL"),
        ("project_mode <> '' AND project_mode <> mode", "project_mode_mismatch", "'error'", "NULL", "NULL"),
        ("NOT coalesce(execution_passed, true)", "mode_execution_failed", "'error'", "NULL", "NULL"),
        ("NOT coalesce(isolation_passed, true)", "mode_isolation_failed", "'error'", "NULL", "NULL"),
    ],
)
_FILE_RULES = Rules(
    ("page", "name"),
    [
        ("image AND NOT readable", "invalid_image", "'error'", "NULL", "NULL"),
        ("image AND readable AND target_width IS NOT NULL AND (width <> target_width OR height <> target_height)", "shape_mismatch", "'error'", "NULL", "NULL"),
        ("name LIKE '%.json' AND NOT readable", "invalid_json", "'error'", "NULL", "NULL"),
        ("strategy IN ('passthrough', 'direct_reject') AND name IN (" + ", ".join(f"'{n}'" for n in PASSTHROUGH_FORBIDDEN) + ")", "passthrough_stale_artifact", "'error'", "NULL", "NULL"),
        ("name LIKE '.%.tmp'", "orphan_temp_file", "'error'", "NULL", "NULL"),
    ],
)
_FILES = "(SELECT f.page AS page, f.name AS name, f.name LIKE '%.png' AS image, f.readable AS readable, f.width AS width, f.height AS height, t.width AS target_width, t.height AS target_height, m.strategy AS strategy FROM {files} f JOIN {runs} m ON m.page = f.page LEFT JOIN (SELECT page, max(width) AS width, max(height) AS height FROM {files} WHERE name = 'target_original.png' AND readable GROUP BY page) t ON t.page = f.page) w"
_REQUIRED = " UNION ALL ".join(
    f"SELECT page, '{name}' AS name FROM {{runs}} r WHERE {when}"
    for when, name in (("direct_used", "direct_patch_layer.png"), ("mask_used", "mask_transfer_layer.png"), ("mask_used", "mask_transfer_mask.png"), ("hybrid_used", "hybrid_transfer_layer.png"), ("hybrid_used", "hybrid_transfer_mask.png"), ("hybrid_texts > 0", "hybrid_text_layer.png"), ("reletter_texts > 0", "reletter_text_layer.png"))
)


def _integrity(rules: str) -> str:
    made = [getattr(RECEIPT_RULES, rules)("{runs} r"), getattr(_FILE_RULES, rules)(_FILES)]
    missing = f"SELECT q.page AS page, q.name AS name, 'missing_route_artifact' AS code, 'error' AS severity, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold FROM ({_REQUIRED}) q LEFT JOIN {{files}} f ON f.page = q.page AND f.name = q.name WHERE f.page IS NULL"
    final = "SELECT r.page, 'final.png', 'missing_final', 'error', NULL, NULL FROM {runs} r LEFT JOIN {files} f ON f.page = r.page AND f.name = 'final.png' WHERE f.page IS NULL"
    leaks = "SELECT page, violation, 'mode_artifact_leak', 'error', NULL, NULL FROM {leaks} k"
    return "SELECT page, name, code FROM (" + " UNION ALL ".join([*made, missing, final, leaks]) + ") every"


#: All rules of a page's workspace: what is there, what is missing, whose it is, what its receipt says.
INTEGRITY = Relation(_integrity("here"), _integrity("there"))
#: What the lifecycle reports of a page whose workspace has issues.
INTEGRITY_FAILED = Relation("SELECT page, 'workspace_integrity_failed' AS code, 'error' AS severity, count(*) AS issues FROM {integrity} i GROUP BY page")
