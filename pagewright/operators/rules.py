"""Rules, gates, classifiers and roll-ups over page, match and transfer rows."""

from __future__ import annotations

from ..plans.relation import Relation

#: Label sets of semantic routing and the types of labels (fixed values).
IGNORED = ("number", "page_number", "header", "header_image", "footer", "footer_image", "footnote", "copyright")
PROCESSED = ("text", "vertical_text", "dialogue", "narration", "dialogue_candidate", "narration_candidate", "effect_text", "sfx", "bubble")
REVIEWED = ("aside_text", "unknown", "doc_title", "paragraph_title", "chapter_title", "other_text", "artwork_text", "furigana")
TYPES = {
    "number": "page_number", "page_number": "page_number", "header": "header", "header_image": "header", "footer": "footer", "footer_image": "footer", "footnote": "footer",
    "text": "dialogue_candidate", "vertical_text": "dialogue_candidate", "sfx": "effect_text", "effect_text": "effect_text", "doc_title": "chapter_title", "paragraph_title": "chapter_title",
}
LABELS = (*IGNORED, *PROCESSED, *REVIEWED)

_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_type = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " WHEN '' THEN 'unknown' ELSE label END"

#: PROCESS, IGNORE or REVIEW for (label, confidence, strategy).
ROUTES = Relation(f"""
SELECT id, label, strategy, semantic_type, action, action = 'PROCESS' AS processable FROM (
  SELECT *, CASE WHEN label IN {_in(IGNORED)} OR semantic_type IN {_in(IGNORED)} THEN 'IGNORE' WHEN strategy = 'analysis_only' THEN 'REVIEW'
    WHEN strategy = 'strict' THEN CASE WHEN label IN {_in(PROCESSED)} AND confidence >= 0.62 THEN 'PROCESS' ELSE 'REVIEW' END
    WHEN strategy = 'loose' THEN CASE WHEN label IN {_in((*PROCESSED, *REVIEWED))} THEN 'PROCESS' ELSE 'REVIEW' END
    WHEN label IN {_in(PROCESSED)} THEN 'PROCESS' ELSE 'REVIEW' END AS action
  FROM (SELECT *, {_type} AS semantic_type FROM {{labels}}) l
) r""")

#: Labels for parts: a fixed one for each type number.
PART_LABELS = Relation("SELECT p_partkey AS id, lower(trim(CASE p_partkey % 26 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LABELS)) + " ELSE ' Text ' END)) AS label, CAST(p_size AS DOUBLE) / 50 AS confidence, CASE p_size % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'strict' WHEN 2 THEN 'loose' ELSE 'analysis_only' END AS strategy FROM {part}")

#: Lettering results of the second edition's regions.
LETTERING = Relation("SELECT page, rid, rid % 11 <> 0 AS success, CASE WHEN rid % 4 = 0 THEN 0.99 ELSE 0.999 END AS coverage, 8 + CAST(text_len AS INT) % 9 AS font_size FROM {target} WHERE rid % 8 <> 7")

SUMMARY = Relation("""
SELECT page, count(CASE WHEN severity = 'error' THEN 1 END) AS errors, count(CASE WHEN severity = 'warning' THEN 1 END) AS warnings, count(CASE WHEN severity = 'info' THEN 1 END) AS infos,
  count(CASE WHEN severity = 'error' THEN 1 END) = 0 AS passed FROM {issues} GROUP BY page""")

BOOK_ROLLUP = Relation("""
SELECT p.book AS book, count(*) AS pages, CAST(coalesce(sum(s.errors), 0) AS BIGINT) AS errors, CAST(coalesce(sum(s.warnings), 0) AS BIGINT) AS warnings, count(CASE WHEN s.page IS NULL OR s.errors = 0 THEN 1 END) AS passed,
  min(p.registration_confidence) AS lowest_registration FROM {pages} p LEFT JOIN {summary} s ON s.page = p.page GROUP BY p.book""")

CODE_CUBE = Relation("""
SELECT coalesce(code, '*') AS code, coalesce(severity, '*') AS severity, count(*) AS n, count(DISTINCT page) AS pages FROM {issues} GROUP BY ROLLUP (severity, code)""")

#: The audit of transfer records, page by page.
RECORD_SUMMARY = Relation("""
SELECT page, count(*) AS records, count(CASE WHEN applied THEN 1 END) AS applied, count(CASE WHEN NOT applied THEN 1 END) AS rejected, count(CASE WHEN content_check LIKE 'checked%' THEN 1 END) AS content_checked,
  count(CASE WHEN content_complete THEN 1 END) AS content_complete, count(CASE WHEN content_check LIKE 'checked%' AND NOT content_complete THEN 1 END) AS content_incomplete,
  count(CASE WHEN applied AND content_check NOT LIKE 'checked%' THEN 1 END) AS content_unverified, count(CASE WHEN repair_attempted THEN 1 END) AS repair_attempted, count(CASE WHEN repair_succeeded THEN 1 END) AS repair_succeeded,
  count(CASE WHEN triage = 'SAFE' THEN 1 END) AS triage_safe, count(CASE WHEN triage = 'REVIEW' THEN 1 END) AS triage_review, count(CASE WHEN triage = 'REJECT' THEN 1 END) AS triage_reject,
  coalesce(min(CASE WHEN content_check LIKE 'checked%' THEN source_ink_coverage END), 0.0) AS min_source_ink_coverage, coalesce(max(CASE WHEN content_check LIKE 'checked%' THEN target_residual_ratio END), 0.0) AS max_target_residual_ratio,
  count(CASE WHEN review_required THEN 1 END) AS review_required, count(CASE WHEN candidate THEN 1 END) AS low_confidence_candidates, count(CASE WHEN geometry_mode = 'ocr_guided_components' THEN 1 END) AS ocr_guided_records,
  count(CASE WHEN geometry_mode = 'complex_text' THEN 1 END) AS complex_text_records FROM {records} GROUP BY page""")

REASONS = Relation("SELECT CASE WHEN reason IS NULL OR reason = '' THEN 'unknown' ELSE reason END AS reason, count(*) AS n FROM {records} GROUP BY CASE WHEN reason IS NULL OR reason = '' THEN 'unknown' ELSE reason END")

TRIAGED = Relation("""
SELECT r.*, CASE WHEN NOT applied THEN 'REJECT' WHEN confidence < 0.55 THEN 'REJECT' WHEN content_check LIKE 'checked%' AND content_complete AND confidence >= 0.82 AND NOT review_required THEN 'SAFE' ELSE 'REVIEW' END AS triage FROM {records} r""")

#: A page is as good as its regions; a page without regions is rejected.
PAGE_TRIAGE = Relation("""
SELECT p.page AS page, CASE WHEN count(CASE WHEN t.triage = 'REJECT' THEN 1 END) > 0 THEN CASE WHEN count(CASE WHEN t.triage <> 'REJECT' THEN 1 END) = 0 THEN 'REJECT' ELSE 'REVIEW' END
  WHEN count(CASE WHEN t.triage = 'REVIEW' THEN 1 END) > 0 THEN 'REVIEW' WHEN count(CASE WHEN t.triage = 'SAFE' THEN 1 END) > 0 THEN 'SAFE' ELSE 'REJECT' END AS triage
FROM {pages} p LEFT JOIN {triaged} t ON t.page = p.page GROUP BY p.page""")

REVIEW_ROWS = Relation("SELECT page, rid, kind, confidence, CASE WHEN reason IS NULL OR reason = '' THEN 'unknown' ELSE reason END AS reason FROM {records} WHERE review_required")

COMPLETION_NEEDED = Relation("""
SELECT p.page AS page, count(r.page) = 0 OR count(CASE WHEN NOT r.applied OR r.review_required THEN 1 END) > 0 AS needed FROM {pages} p LEFT JOIN {records} r ON r.page = p.page GROUP BY p.page""")

#: The first measure of registration that fails, in order; NaN never fails a bound, as in IEEE comparison.
REGISTRATION_GATE = Relation("""
SELECT page, CASE WHEN registration_confidence < 0.62 THEN 'registration_confidence' WHEN reprojection_error > 6.0 AND NOT isnan(reprojection_error) THEN 'registration_reprojection_error' WHEN inlier_ratio < 0.30 THEN 'registration_inlier_ratio'
  WHEN spatial_coverage < 0.08 THEN 'registration_spatial_coverage' ELSE 'ok' END AS reason FROM {pages}""")

#: The best safe source of a book's pages; of equals the first edition.
SELECTED_SOURCE = Relation("""
SELECT book, page, score FROM (SELECT book, page, score, row_number() OVER (PARTITION BY book ORDER BY score DESC, is_secondary, page) AS turn FROM {evidence} WHERE safe AND reasons = 0) r WHERE turn = 1""")

#: What a mode may do (fixed values): name, direct, mask, reletter, transparent, aligned, orchestrator, mask fallback, recognises text.
MODES = """(SELECT * FROM (VALUES ('direct_patch', true, false, false, false, false, false, false, false), ('mask_replace', false, true, false, false, false, false, false, false),
  ('aligned_overlay_reveal', false, false, false, false, true, false, false, false), ('transparent_bubble_reveal', false, false, false, true, false, false, false, false),
  ('hybrid', false, true, true, false, false, false, false, true), ('reletter', false, false, true, false, false, false, false, true), ('auto', true, true, false, false, false, true, true, true))
  AS v(mode, direct, mask, reletter, transparent, aligned, orchestrator, mask_fallback, recognises))"""

#: Subsystems that ran although the page's mode doesn't allow them, and recognition where it is forbidden.
MODE_VIOLATIONS = Relation(f"""
SELECT r.page AS page, r.mode AS mode, concat_ws(',', CASE WHEN r.used_aligned AND NOT m.aligned THEN 'aligned_overlay_reveal' END, CASE WHEN r.used_direct AND NOT m.direct THEN 'direct' END,
  CASE WHEN r.used_mask AND NOT m.mask AND NOT (m.orchestrator AND m.mask_fallback) THEN 'mask_replace' END, CASE WHEN r.used_reletter AND NOT m.reletter THEN 'reletter' END,
  CASE WHEN r.used_transparent AND NOT m.transparent THEN 'transparent_bubble_reveal' END) AS violations,
  NOT m.recognises AND NOT (lower(trim(r.route)) = '' OR lower(trim(r.route)) LIKE 'skipped%' OR lower(trim(r.route)) IN ('none', 'null', 'disabled', 'geometry_only')) AS ocr_violation
FROM (
  SELECT o_orderkey AS page, CASE o_orderkey % 7 WHEN 0 THEN 'direct_patch' WHEN 1 THEN 'mask_replace' WHEN 2 THEN 'aligned_overlay_reveal' WHEN 3 THEN 'transparent_bubble_reveal' WHEN 4 THEN 'hybrid' WHEN 5 THEN 'reletter' ELSE 'auto' END AS mode,
    o_custkey % 2 = 0 AS used_direct, o_custkey % 3 = 0 AS used_mask, o_custkey % 5 = 0 AS used_reletter, o_custkey % 7 = 0 AS used_transparent, o_custkey % 11 = 0 AS used_aligned,
    CASE o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'skipped_mode' WHEN 2 THEN ' NONE ' WHEN 3 THEN 'cache' WHEN 4 THEN 'geometry_only' ELSE 'engine' END AS route FROM {{orders}}
) r JOIN {MODES} m ON m.mode = r.mode""")
