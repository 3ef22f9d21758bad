"""Decision tables and gates: what a page, a mode, a detector or a region may do, and why.

Every operator reads its inputs from columns; the rows of the driver's tables are turned into such columns
by the adapters.
"""

from __future__ import annotations

from ..functions import geometry as g
from ..plans.relation import Relation

_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"

#: Layout labels under other names (fixed values).
LABEL_ALIASES = {"onomatopoeia": "sfx", "sound_effect": "sfx", "speech_bubble": "bubble"}
NORMAL_LABEL = "(CASE replace(lower(trim(coalesce({x}, ''))), '-', '_') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_ALIASES.items()) + " ELSE replace(lower(trim(coalesce({x}, ''))), '-', '_') END)"

#: Labels of layout items as they are compared.
LABELS = Relation(f"SELECT id, {NORMAL_LABEL.format(x='label')} AS label FROM {{labelled}}")
#: Layout items as text blocks (text is speech, sound effects stay what they are) and as bubbles.
LAYOUT_BLOCKS = Relation("SELECT page, concat('layout-text-', lpad(CAST(rid AS STRING), 4, '0')) AS id, rid AS reading_order, CASE label WHEN 'text' THEN 'speech' ELSE 'sfx' END AS kind, confidence FROM {items} i WHERE label IN ('text', 'sfx')")
LAYOUT_BUBBLES = Relation("SELECT page, concat('layout-bubble-', lpad(CAST(rid AS STRING), 4, '0')) AS id, confidence, x0, y0, x1, y1 FROM {items} i WHERE label = 'bubble'")

#: Recognised blocks sure enough, and those to review; a confidence that is no number is never sure.
SURE_BLOCKS = Relation("SELECT page, rid, CASE WHEN confidence >= 0.66 AND NOT isnan(confidence) THEN 'accepted' ELSE 'review' END AS verdict FROM {regions} r")

#: Candidates that layout supports, or says nothing of.
KEPT_BY_AUTHORITY = Relation("SELECT page, rid, state, state = 'ALLOW' OR (state = 'UNKNOWN' AND allow_unknown) AS accepted FROM {authority} a")

_support = lambda p: f"CASE WHEN s.region_kind IN ('complex_text', 'free_text') THEN {p}text >= 0.35 OR {p}sfx >= 0.35 WHEN s.region_kind = 'bubble' THEN {p}bubble >= 0.25 OR {p}text >= 0.35 ELSE {p}bubble >= 0.25 OR {p}text >= 0.35 OR {p}sfx >= 0.35 END"
#: The two-sided gate of proposals: both sides need support of the kind of the region; without evidence on a side, or with a side missing, a proposal stays.
SAFETY_GATE = Relation(f"""
SELECT page, record, source_ok AND target_ok OR open AS kept,
  CASE WHEN open THEN 'open' WHEN source_ok AND target_ok THEN 'two_sided_support' WHEN (NOT source_ok AND s_panel >= 0.20) OR (NOT target_ok AND t_panel >= 0.20) THEN 'panel_only' ELSE 'missing_two_sided_support' END AS reason
FROM (
  SELECT p.page AS page, p.record AS record, s.page IS NULL OR t.page IS NULL OR NOT p.source_available OR NOT p.target_available AS open, coalesce(s.panel, 0.0) AS s_panel, coalesce(t.panel, 0.0) AS t_panel,
    coalesce({_support('s.')}, false) AS source_ok, coalesce({_support('t.')}, false) AS target_ok
  FROM {{proposals}} p LEFT JOIN {{source}} s ON s.page = p.page AND s.rid = p.source LEFT JOIN {{target}} t ON t.page = p.page AND t.rid = p.target
) x""")

#: Completion pairs neither side of which is protected.
COMPLETION_PAIRS = Relation("""
SELECT p.page AS page, p.source AS source, p.target AS target, coalesce(s.state, 'UNKNOWN') <> 'PROTECT' AND coalesce(t.state, 'UNKNOWN') <> 'PROTECT' AS passed
FROM {proposals} p LEFT JOIN {source} s ON s.page = p.page AND s.rid = p.source LEFT JOIN {target} t ON t.page = p.page AND t.rid = p.target""")

#: Regions that are done: applied, complete, not under review; the first group that has a region names it.
EXISTING = Relation("""
SELECT page, rid, grp FROM (
  SELECT c.page AS page, c.rid AS rid, c.grp AS grp, row_number() OVER (PARTITION BY c.page, c.rid ORDER BY c.grp) AS turn
  FROM {candidates} c LEFT SEMI JOIN (SELECT page, rid FROM {records} r WHERE applied AND NOT review_required AND coalesce(content_complete, true)) d ON d.page = c.page AND d.rid = c.rid
) x WHERE turn = 1""",
"""
SELECT page, rid, min(grp) AS grp FROM {candidates} c WHERE EXISTS (SELECT 1 FROM {records} r WHERE r.page = c.page AND r.rid = c.rid AND r.applied AND NOT r.review_required AND coalesce(r.content_complete, true)) GROUP BY page, rid""")  # fmt: skip
#: Boxes that need completion.
REVIEW_BOXES = Relation("SELECT page, rid, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM {records} r WHERE review_required OR NOT coalesce(content_complete, true) OR NOT applied")

#: Pages with text that can be transferred: a block with text in a bubble of an enabled kind, by its bubble's id or by its centre in a candidate's box.
TRANSFERABLE = Relation(f"""
SELECT DISTINCT page FROM (
  SELECT b.page AS page FROM {{blocks}} b JOIN {{bubbles}} u ON u.page = b.page AND u.rid = b.bubble_id WHERE b.text_len > 0 AND u.kind IN ('speech', 'narration')
  UNION ALL
  SELECT b.page FROM {{blocks}} b JOIN {{candidates}} c ON c.page = b.page AND {g.holds('c.', *g.centre('b.'))} WHERE b.text_len > 0 AND c.kind IN ('speech', 'narration')
) x""")
#: Whether a page surely has no text to transfer; what is unsure counts as having it.
CONTENT_GATE = Relation("""
SELECT p.page AS page, CASE WHEN lower(trim(coalesce(p.backend, ''))) IN ('', 'none', 'null') OR coalesce(p.route, '') LIKE 'skipped%' THEN false WHEN coalesce(b.texts, 0) = 0 THEN true WHEN p.region_text_only THEN t.page IS NULL ELSE false END AS empty
FROM {pages} p LEFT JOIN (SELECT page, count(CASE WHEN text_len > 0 THEN 1 END) AS texts FROM {blocks} GROUP BY page) b ON b.page = p.page LEFT JOIN {transferable} t ON t.page = p.page""")

#: Sharp transfers whose layout stays as it is.
SHARP_MODES = ("photo-crisp-ink", "ink-reconstruction", "locked-source-container-patch")
PRESERVED = Relation(f"SELECT page, rid, applied AND NOT review_required AND relative_sharpness >= 1.15 AND clarity_mode IN {_in(SHARP_MODES)} AS preserved FROM {{records}} r")

#: Whether a kept layout lost columns, rows, extent or size of glyphs, by the direction of its text.
LAYOUT_COMPLETE = Relation("""
SELECT id, CASE WHEN orientation = 'vertical' THEN NOT ((s_columns >= 2 AND t_columns < s_columns) OR (s_rows >= 4 AND t_rows + 1 < s_rows) OR (s_columns >= 2 AND t_fill_x < s_fill_x * 0.72) OR (t_pitch > 0 AND s_pitch > 0 AND t_pitch < s_pitch * 0.58))
  ELSE NOT ((s_rows >= 2 AND t_rows < s_rows) OR (s_columns >= 4 AND t_columns + 1 < s_columns) OR (s_rows >= 2 AND t_fill_y < s_fill_y * 0.72) OR (t_pitch > 0 AND s_pitch > 0 AND t_pitch < s_pitch * 0.58)) END AS complete
FROM {profiles} p""")

#: What a direct plan must not have done, as a list; incomplete content is listed but blocks nothing.
INVARIANTS = Relation("""
SELECT page, issue, issue NOT LIKE 'content_incomplete:%' AS blocking FROM (
  SELECT page, CASE WHEN border_pixels <> 0 THEN 'alignment_border_was_written' END AS issue FROM {plans} p
  UNION ALL SELECT page, CASE WHEN ocr_used THEN 'ocr_used_on_source_direct_route' END FROM {plans} p
  UNION ALL SELECT page, CASE WHEN bubble_matching_used THEN 'target_bubble_matching_used' END FROM {plans} p
  UNION ALL SELECT page, CASE WHEN NOT present THEN 'missing_plan' END FROM {missing} p
  UNION ALL SELECT page, CASE WHEN NOT coalesce(content_complete, false) THEN concat('content_incomplete:', source_id) END FROM {records} r
) x WHERE issue IS NOT NULL""")

#: Types of pages, and whether they are processed (fixed values).
PAGE_TYPES = ("content", "auto_no_text", "cover", "title_page", "toc_page", "chapter_title", "illustration", "frontispiece", "blank", "back_matter", "skip")
_known = lambda t: f"CASE WHEN {t} IN {_in(PAGE_TYPES)} THEN {t} ELSE 'content' END"
#: Marks as stored, made valid: unknown types are content, and what an old release set by itself is taken back.
MARK_ROWS = Relation(f"""
SELECT key, target_name, CASE WHEN page_type = 'auto_no_text' AND origin <> 'manual' THEN 'content' ELSE page_type END AS page_type, CASE WHEN page_type = 'auto_no_text' AND origin <> 'manual' THEN 'default' ELSE origin END AS origin,
  CASE WHEN page_type = 'auto_no_text' AND origin <> 'manual' THEN 'legacy_auto_no_text_reset_to_content' ELSE reason END AS reason
FROM (SELECT key, target_name, {_known("coalesce(nullif(page_type, ''), 'content')")} AS page_type, coalesce(nullif(origin, ''), 'default') AS origin, coalesce(reason, '') AS reason FROM {{marks}}) m""")
#: A page's mark: by its key, else the first by the name of its target, else the default.
RESOLVED_MARKS = Relation("""
SELECT p.page AS page, coalesce(a.page_type, b.page_type, 'content') AS page_type, CASE WHEN a.key IS NOT NULL THEN a.origin WHEN b.key IS NOT NULL THEN b.origin ELSE 'default' END AS origin, coalesce(a.page_type, b.page_type, 'content') = 'content' AS processed
FROM {pages} p LEFT JOIN {marks} a ON a.key = p.key LEFT JOIN (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY target_name ORDER BY key) AS turn FROM {marks} m WHERE target_name <> '') x WHERE turn = 1) b ON a.key IS NULL AND b.target_name = p.target_name""")
#: Regions of a page by kind, over first and further results.
REGION_COUNTS = Relation("SELECT page, count(CASE WHEN kind = 'free_text' THEN 1 END) AS free_text, count(CASE WHEN kind <> 'free_text' THEN 1 END) AS bubbles, count(*) AS total FROM (SELECT page, kind FROM {first} a UNION ALL SELECT page, kind FROM {further} b) x GROUP BY page")
#: What a probe says of a page: no result keeps it; a page surely registered without bubbles is skipped where that is asked for.
PROBED_MARKS = Relation("""
SELECT page, CASE WHEN total IS NOT NULL AND skip_asked AND sure AND bubbles = 0 THEN 'auto_no_text' ELSE 'content' END AS page_type, greatest(0.0, least(1.0, registration_confidence)) AS confidence,
  CASE WHEN total IS NULL THEN 'no_geometry_evidence;keep_for_processing' WHEN skip_asked AND sure AND bubbles = 0 THEN concat('no_balloon_or_textbox_regions', CASE WHEN free_text > 0 THEN concat(';free_text_only=', CAST(free_text AS STRING)) WHEN total = 0 THEN ';no_transfer_regions' ELSE '' END)
    WHEN sure THEN concat('transfer_regions=', CAST(total AS STRING), ';bubble_regions=', CAST(bubbles AS STRING), ';free_text_regions=', CAST(free_text AS STRING)) ELSE 'registration_too_low_for_auto_skip' END AS reason
FROM (SELECT p.page AS page, p.registration_confidence AS registration_confidence, p.registration_confidence >= 0.72 AS sure, p.skip_asked AS skip_asked, c.total AS total, c.bubbles AS bubbles, c.free_text AS free_text FROM {pages} p LEFT JOIN {counts} c ON c.page = p.page) x""")
#: Whether a finished page may be taken again under the mark now asked for.
RESUME_MARKS = Relation("""
SELECT page, CASE WHEN origin IS NULL OR origin = 'default' THEN true WHEN processed THEN NOT passthrough OR passthrough_reason = 'source_no_transferable_text' WHEN NOT passthrough THEN false WHEN origin = 'manual' THEN coalesce(cached_type, '') = page_type ELSE true END AS allowed FROM {cached} c""")

#: The route of a page by the mode asked for and the plans there are (strategy, reason, whether another may follow).
STRATEGIES = Relation("""
SELECT page, mode, CASE mode
  WHEN 'aligned_overlay_reveal' THEN CASE WHEN NOT same_page OR NOT aligned_available THEN 'aligned_overlay_reveal_reject' ELSE 'aligned_overlay_reveal' END
  WHEN 'direct_patch' THEN CASE WHEN NOT same_page OR NOT direct_available THEN 'direct_reject' ELSE 'direct_patch' END
  WHEN 'auto' THEN CASE WHEN same_page AND direct_available AND direct_safe THEN 'direct_patch' WHEN same_page AND aligned_allowed AND aligned_available THEN 'aligned_overlay_reveal' ELSE 'mask_replace' END ELSE mode END AS strategy,
  CASE mode
  WHEN 'aligned_overlay_reveal' THEN CASE WHEN NOT same_page THEN 'page_pair_verification_failed' WHEN NOT aligned_available THEN 'no_accepted_aligned_overlay_plan' ELSE 'explicit_aligned_overlay_reveal' END
  WHEN 'direct_patch' THEN CASE WHEN NOT same_page THEN 'page_pair_verification_failed' WHEN NOT direct_available THEN 'no_safe_direct_container_plan' WHEN secondary_selected THEN 'explicit_direct_patch_secondary' ELSE 'explicit_direct_patch' END
  WHEN 'auto' THEN CASE WHEN same_page AND direct_available AND direct_safe THEN CASE WHEN secondary_selected THEN 'safe_secondary_direct_plan' ELSE 'safe_source_direct_plan' END
    WHEN same_page AND aligned_allowed AND aligned_available THEN 'explicitly_allowed_aligned_overlay_fallback' ELSE 'direct_not_safe_fallback_to_mask' END ELSE 'explicit_mode' END AS reason,
  mode IN ('auto', 'hybrid') AS fallback_allowed,
  concat_ws(',', CASE WHEN secondary_available AND NOT secondary_selected AND NOT chosen THEN 'retry_direct_with_secondary_source' END, CASE WHEN NOT direct_chosen THEN 'force_direct_patch' END, 'force_mask_replace', 'skip_unit') AS actions
FROM (SELECT p.*, (mode = 'aligned_overlay_reveal' AND same_page AND aligned_available) OR (mode = 'direct_patch' AND same_page AND direct_available) OR (mode = 'auto' AND same_page AND ((direct_available AND direct_safe) OR (aligned_allowed AND aligned_available))) AS chosen,
  (mode = 'direct_patch' AND same_page AND direct_available) OR (mode = 'auto' AND same_page AND direct_available AND direct_safe) AS direct_chosen FROM {pages} p) x""")

#: Whether a unit counts as in a bubble: by its bubble, its geometry or its kind.
UNIT_KINDS = Relation("SELECT page, rid, CASE WHEN trim(coalesce(bubble_id, '')) <> '' OR lower(trim(coalesce(geometry, ''))) = 'bubble' OR lower(trim(coalesce(kind, ''))) IN ('speech', 'narration', 'dialogue', 'dialog') THEN 'bubble' ELSE 'free_text' END AS region_kind FROM {units} u")

_rescued = lambda a, b, recovered: f"({a}.state = 'PROTECT' AND {b}.state = 'ALLOW' AND {a}.reason = 'panel_only' AND (({recovered} AND {a}.bubble >= 0.45) OR ({a}.bubble >= 0.55 AND {a}.text >= 0.10 AND ({b}.text >= 0.35 OR {b}.bubble >= 0.55))))"
#: A sure pairing by ids brings back a side that layout protects by mistake, if the other side is allowed.
RESCUED = Relation(f"""
SELECT m.page AS page, m.source AS source, m.target AS target, m.mode IN ('reletter', 'hybrid') AND m.route = 'direct' AND m.confidence >= 0.92 AND m.registration_confidence >= 0.70 AND m.source_bubble IS NOT NULL AND m.target_bubble IS NOT NULL
  AND ({_rescued('s', 't', 'm.source_recovered')} OR {_rescued('t', 's', 'false')}) AS rescued
FROM {{pairs}} m JOIN {{source}} s ON s.page = m.page AND s.rid = m.source JOIN {{target}} t ON t.page = m.page AND t.rid = m.target""")

#: Detectors that may help the first one, and the names of old settings (fixed values).
AUXILIARIES = ("geometry_white", "mangalens", "rtdetr_v2", "ysg_obb", "koharu_layout", "sidecar", "ctd_sidecar", "sam2")
PRIMARIES = ("koharu_layout", "mangalens", "rtdetr_v2")
_primary = f"CASE WHEN lower(trim(coalesce(c.first, ''))) IN {_in(PRIMARIES)} THEN lower(trim(c.first)) ELSE 'koharu_layout' END"
#: Further detectors of a page's settings in the order given: known ones, each once, not the first; an old setting comes last.
DETECTORS = Relation(f"""
SELECT page, name, row_number() OVER (PARTITION BY page ORDER BY place) - 1 AS place FROM (
  SELECT page, name, min(place) AS place FROM (
    SELECT c.page AS page, lower(trim(a.name)) AS name, a.place AS place, {_primary} AS first FROM {{settings}} c JOIN {{auxiliaries}} a ON a.page = c.page
    UNION ALL SELECT c.page, CASE lower(trim(coalesce(c.legacy, ''))) WHEN 'seeded_white' THEN 'geometry_white' ELSE lower(trim(coalesce(c.legacy, ''))) END, 1000, {_primary} FROM {{settings}} c
  ) n WHERE name IN {_in(AUXILIARIES)} AND name <> first GROUP BY page, name
) d""")
#: Whether further detectors run: never, always, or where the first isn't enough.
RUN_DETECTORS = Relation("SELECT page, CASE lower(trim(coalesce(strategy, ''))) WHEN 'primary_only' THEN false WHEN 'primary_plus_aux' THEN true ELSE NOT sufficient END AS runs FROM {settings} c")

#: Whether manual work on a page belongs to the mode asked for, and whether there is any.
REVIEW_STATE = Relation("""
SELECT page, coalesce(lower(trim(owner)), '') IN ('', lower(trim(requested))) AS compatible, coalesce(lower(trim(owner)), '') IN ('', lower(trim(requested))) AND (markers > 0 OR rows > 0 OR maps > 0 OR trim(coalesce(forced, '')) <> '') AS reapplicable FROM {reviews} r""")

#: What of a run's evidence is seen without text: pairs, and those sure enough.
VISUAL_EVIDENCE = Relation("""
SELECT p.page AS page, coalesce(r.records, 0) AS records, coalesce(r.strong, 0) AS strong, least(p.source_bubbles, p.target_bubbles) > 0 AND (coalesce(r.strong, 0) > 0 OR coalesce(r.records, 0) = 0) AS available
FROM {pages} p LEFT JOIN (SELECT page, count(*) AS records, count(CASE WHEN confidence >= 0.55 THEN 1 END) AS strong FROM {records} GROUP BY page) r ON r.page = p.page""")
#: Regions applied and failed as a mode's own counters say, else as its records do.
MODE_EFFECTS = Relation("""
SELECT p.page AS page, coalesce(p.applied_count, p.successful_regions, p.accepted_count, p.region_count, r.applied, 0) AS applied, coalesce(p.failed_regions, p.failed_count, 0) AS failed, p.old_mode <> '' AND p.old_mode <> p.mode AS mode_changed
FROM {pages} p LEFT JOIN (SELECT page, count(CASE WHEN coalesce(applied, true) THEN 1 END) AS applied FROM {records} GROUP BY page) r ON r.page = p.page""")
#: Whether finished pages of a book are large enough to be loaded ahead: the upper middle of at most 16 evenly taken sizes.
AHEAD = Relation("""
SELECT book, sizes, middle >= 16384 AS worthwhile FROM (
  SELECT book, sizes, max(CASE WHEN place = CAST(floor(sizes / 2) AS INT) + 1 THEN bytes END) AS middle FROM (
    SELECT book, bytes, count(*) OVER (PARTITION BY book) AS sizes, row_number() OVER (PARTITION BY book ORDER BY bytes, page) AS place FROM (
      SELECT p.book AS book, p.page AS page, p.bytes AS bytes FROM (SELECT q.*, row_number() OVER (PARTITION BY book ORDER BY page) - 1 AS at, count(*) OVER (PARTITION BY book) AS n FROM {pages} q) p
      JOIN (SELECT DISTINCT b.book AS book, CAST({even} AS BIGINT) AS at FROM (SELECT book, count(*) AS n FROM {pages} GROUP BY book) b JOIN {sixteen} i ON i.k < least(16, b.n)) s ON s.book = p.book AND s.at = p.at WHERE p.bytes IS NOT NULL
    ) t
  ) u GROUP BY book, sizes
) v""".replace("{even}", "rint(CAST(i.k * (b.n - 1) AS DOUBLE) / greatest(1, least(16, b.n) - 1))"))
AHEAD.other = AHEAD.sql.replace("rint(", "round_even(").replace("least(16, b.n) - 1))", "least(16, b.n) - 1), 0)")

#: The newest of a page's results, the first named of equals; and the reviewed and automatic ones by the order of their places.
RESULTS = Relation("""
SELECT page, max(CASE WHEN turn = 1 THEN path END) AS current, max(CASE WHEN reviewed_turn = 1 AND role = 'reviewed' THEN path END) AS reviewed, max(CASE WHEN reviewed_turn = 1 AND role = 'automatic' THEN path END) AS automatic FROM (
  SELECT page, role, path, row_number() OVER (PARTITION BY page ORDER BY modified DESC, place) AS turn, row_number() OVER (PARTITION BY page, role ORDER BY place) AS reviewed_turn FROM {results} r WHERE present
) x GROUP BY page""")
#: The folder of a page: the one named, else the first of its own, the plain and the old name that is there, else its own.
WORKSPACES = Relation("""
SELECT p.page AS page, coalesce(max(CASE WHEN f.turn = 1 THEN f.folder END), max(p.own)) AS folder FROM {pages} p LEFT JOIN (SELECT page, folder, row_number() OVER (PARTITION BY page ORDER BY place) AS turn FROM {folders} WHERE present) f ON f.page = p.page GROUP BY p.page""")

#: Registration by three measures; an error that is no finite number fails.
REVEAL_GATE = Relation("""
SELECT page, CASE WHEN registration_confidence < 0.62 THEN 'registration_confidence' WHEN isnan(reprojection_error) OR abs(reprojection_error) > 1e300 OR reprojection_error > 6.0 THEN 'registration_reprojection_error' WHEN inlier_ratio < 0.30 THEN 'registration_inlier_ratio' ELSE 'ok' END AS reason FROM {pages} p""")
#: Detectors that model closed containers (fixed values), and those whose regions are seeded by text.
CLOSED = ("test", "koharu_layout", "seeded_white", "unseeded_white", "unseeded", "text_seed_white_container", "text_seed_white_rect", "mangalens", "rtdetr_v2", "sam2")
REVEAL_AUTHORITY = Relation(f"SELECT page, rid, lower(trim(coalesce(backend, ''))) IN {_in(CLOSED)} AS closed, lower(trim(coalesce(backend, ''))) IN ('test', 'seeded_white', 'text_seed_white_rect') OR has_text_box AS anchored FROM {{regions}} r")
#: Seeds whose rounded centre an accepted region holds.
COVERED_SEEDS = Relation(f"""
SELECT DISTINCT s.page AS page, s.rid AS rid FROM {{seeds}} s JOIN {{accepted}} a ON a.page = s.page
WHERE {g.holds('a.', 'greatest(0.0, least(799.0, rint((s.x0 + s.x1) * 0.5)))', 'greatest(0.0, least(1099.0, rint((s.y0 + s.y1) * 0.5)))')}""")
COVERED_SEEDS.other = COVERED_SEEDS.sql.replace("rint((s.x0 + s.x1) * 0.5)", "round_even((s.x0 + s.x1) * 0.5, 0)").replace("rint((s.y0 + s.y1) * 0.5)", "round_even((s.y0 + s.y1) * 0.5, 0)")
#: Regions under another detector's name, numbered in order.
RETAGGED = Relation("SELECT page, concat('tbr-', backend, '-', lpad(CAST(row_number() OVER (PARTITION BY page, backend ORDER BY rid) - 1 AS STRING), 4, '0')) AS id, backend, confidence FROM {regions} r")
#: Regions that are not rejected.
APPLIED_REGIONS = Relation("SELECT page, rid, triage FROM {triaged} t WHERE triage <> 'REJECT'")

#: Registration candidates by quality: measures, less what a model costs, cut where a measure is below its bound.
REGISTRATION_QUALITY = Relation("""
SELECT page, method, quality FROM (SELECT page, method, quality, row_number() OVER (PARTITION BY page ORDER BY quality DESC, place) AS turn FROM (
  SELECT page, method, place, greatest(0.0, least(1.0, (0.50 * inlier_ratio + 0.28 * exp(-error / 5) + 0.22 * least(1.0, coverage / 0.35) - CASE method WHEN 'similarity' THEN 0.0 WHEN 'affine' THEN 0.025 WHEN 'homography' THEN 0.055 ELSE 0.03 END)
    * CASE WHEN inlier_ratio < 0.28 THEN greatest(0.25, inlier_ratio / 0.28) ELSE 1.0 END * CASE WHEN error > 7.0 THEN greatest(0.25, 7.0 / error) ELSE 1.0 END * CASE WHEN coverage < 0.08 THEN greatest(0.35, coverage / 0.08) ELSE 1.0 END)) AS quality
  FROM {candidates} c
) q) r WHERE turn = 1""")

#: Sources of a page weighed: identity and geometry before sharpness, cut to a quarter where a reason speaks against one.
SOURCE_EVIDENCE = Relation("""
SELECT book, page, is_secondary, safe, reasons, greatest(0.0, least(1.0, (0.24 * same_page + 0.20 * registration + 0.12 * exp(-reprojection / 3.0) + 0.18 * coverage + 0.10 * boundary + 0.12 * sharp + 0.04 * (1 - risk)) * CASE WHEN reasons > 0 THEN 0.25 ELSE 1.0 END)) AS score
FROM (
  SELECT book, page, is_secondary, applied > 0 AND plan_safe AS safe, same_page, registration, reprojection, CASE WHEN candidates > 0 THEN least(1.0, CAST(applied AS DOUBLE) / candidates) WHEN applied > 0 THEN 1.0 ELSE 0.0 END AS coverage,
    greatest(0.0, least(1.0, 1 - coalesce(boundary, 5.0) / 5.0)) AS boundary, greatest(0.0, least(1.0, ln(1 + greatest(0.0, sharpness)) / ln(181.0))) AS sharp, CAST(risks AS DOUBLE) / greatest(1, applied + risks) AS risk,
    CASE WHEN same_page < 0.72 THEN 1 ELSE 0 END + CASE WHEN registration < 0.78 THEN 1 ELSE 0 END + CASE WHEN reprojection > 7.0 THEN 1 ELSE 0 END + CASE WHEN applied > 0 AND plan_safe THEN 0 ELSE 1 END AS reasons
  FROM {sources} s
) e""")

#: The confidence of a changed region: registration, overlap, change and ink; and that of a group of glyphs with its label.
DIFF_CONFIDENCE = Relation("SELECT page, rid, greatest(0.0, least(0.995, 0.34 * registration_confidence + 0.38 * mask_iou + 0.18 * least(1.0, density / 0.35) + 0.10 * least(1.0, greatest(source_ink, target_ink) / 0.08))) AS confidence FROM {changes} c")
GROUP_LABELS = Relation("""
SELECT page, rid, CASE WHEN y1 <= 154 AND h <= greatest(52, 66) AND w <= 384 THEN 'header' WHEN y0 >= 1034 AND h <= greatest(42, 44) THEN CASE WHEN w <= greatest(72, 96) THEN 'number' ELSE 'footer' END WHEN glyphs <= 1 AND w <= 42 AND h <= 42 THEN 'unknown' ELSE base END AS label,
  greatest(0.35, least(0.94, 0.42 + 0.34 * least(1.0, glyphs / 8.0) + 0.18 * least(1.0, 18000.0 / greatest(1.0, w * h)))) AS confidence
FROM (
  SELECT g.*, CASE WHEN glyphs < 4 THEN 'unknown' WHEN glyphs <= 5 AND (NOT coherent OR least(glyph_w, glyph_h) < 18.0) THEN 'unknown' WHEN glyphs < 10 AND NOT coherent THEN 'unknown' WHEN vertical THEN 'vertical_text' ELSE 'text' END AS base
  FROM (SELECT q.*, CASE WHEN vertical THEN span_x <= greatest(30.0, glyph_w * 3.2) ELSE span_y <= greatest(26.0, glyph_h * 3.0) END AS coherent FROM (SELECT z.*, x1 - x0 AS w, y1 - y0 AS h, y1 - y0 >= (x1 - x0) * 1.12 AS vertical FROM {groups} z) q) g
) l""")

#: Actions on regions of a page without exact repeats; brush strokes are never repeats.
REGION_ACTIONS = Relation("""
SELECT page, id, mode FROM (SELECT page, id, mode, box, settings, row_number() OVER (PARTITION BY page, lower(trim(mode)), box, settings ORDER BY id) AS turn FROM {actions} a) x WHERE turn = 1 OR lower(trim(mode)) NOT LIKE 'region_%' OR lower(trim(mode)) = 'region_brush_reveal'""".replace("'region_%'", "'region\\\\_%'"),
"""
SELECT page, id, mode FROM (SELECT page, id, mode, box, settings, row_number() OVER (PARTITION BY page, lower(trim(mode)), box, settings ORDER BY id) AS turn FROM {actions} a) x WHERE turn = 1 OR NOT starts_with(lower(trim(mode)), 'region_') OR lower(trim(mode)) = 'region_brush_reveal'""")  # fmt: skip
