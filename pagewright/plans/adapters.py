"""Region, page, trace and mark rows derived from the star-schema tables.

These are stand-ins for rows that a layout detector would deliver; the arithmetic is exact, so any
engine derives the same rows.
"""

from .relation import Relation

_REGION_ID = (
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"
)

#: Text regions of the first edition: one page for each order.
SOURCE_REGIONS = Relation(f"""
SELECT page, rid, x0, y0, x0 + w AS x1, y0 + h AS y1, kind, confidence, text_len, ord, n
FROM (
  SELECT l_orderkey AS page, {_REGION_ID} AS rid, {_REGION_ID} - 1 AS ord, count(*) OVER (PARTITION BY l_orderkey) AS n,
    CAST(l_linenumber * 40 AS DOUBLE) AS x0, CAST((l_partkey % 50) * 20 AS DOUBLE) AS y0, 20 + l_quantity AS w, CAST(10 + l_suppkey % 30 AS DOUBLE) AS h,
    CASE l_returnflag WHEN 'A' THEN 'speech' WHEN 'N' THEN 'narration' ELSE 'sfx' END AS kind,
    CAST(55 + l_partkey % 45 AS DOUBLE) / 100 AS confidence, CAST(l_suppkey % 20 AS DOUBLE) AS text_len
  FROM {{lineitem}}
) regions""")

#: The second edition: the same regions shifted by a few pixels, every fifth supplier's missing.
TARGET_REGIONS = Relation(f"""
SELECT page, rid, x0, y0, x0 + w AS x1, y0 + h AS y1, kind, confidence, text_len, row_number() OVER (PARTITION BY page ORDER BY rid) - 1 AS ord, count(*) OVER (PARTITION BY page) AS n
FROM (
  SELECT l_orderkey AS page, {_REGION_ID} AS rid, l_suppkey,
    CAST(l_linenumber * 40 + (l_partkey % 7) - 3 AS DOUBLE) AS x0, CAST((l_partkey % 50) * 20 + (l_suppkey % 5) - 2 AS DOUBLE) AS y0, 20 + l_quantity AS w, CAST(10 + l_suppkey % 30 AS DOUBLE) AS h,
    CASE WHEN l_returnflag = 'A' OR l_partkey % 9 = 0 THEN 'speech' WHEN l_returnflag = 'N' THEN 'narration' ELSE 'unknown' END AS kind,
    CAST(60 + l_suppkey % 40 AS DOUBLE) / 100 AS confidence, CAST((l_suppkey + l_partkey) % 20 AS DOUBLE) AS text_len
  FROM {{lineitem}}
) regions WHERE l_suppkey % 5 <> 0""")

#: Registration measures of a page.
PAGES = Relation("""
SELECT o_orderkey AS page, o_custkey AS book, CAST(40 + o_orderkey % 61 AS DOUBLE) / 100 AS pair_confidence, CAST(45 + o_custkey % 56 AS DOUBLE) / 100 AS registration_confidence,
  CAST(o_orderkey % 13 AS DOUBLE) / 1.5 AS reprojection_error, CAST(20 + o_custkey % 80 AS DOUBLE) / 100 AS inlier_ratio, CAST(o_orderkey % 40 AS DOUBLE) / 100 AS spatial_coverage
FROM {orders}""")

#: Transfer records, one for each region of the first edition.
RECORDS = Relation("""
SELECT page, rid, kind, confidence, rid % 6 <> 0 AS applied, CASE WHEN rid % 4 = 0 THEN 'not_checked' WHEN rid % 4 = 1 THEN 'checked_ink' ELSE 'checked' END AS content_check,
  CAST(text_len AS INT) % 3 <> 0 AS content_complete, CAST(y0 AS INT) % 60 = 0 AS review_required, CAST(x0 AS INT) % 80 = 0 AS candidate,
  rid % 5 = 0 AS repair_attempted, rid % 10 = 0 AS repair_succeeded,
  CASE WHEN rid % 3 = 0 THEN 'ocr_guided_components' WHEN rid % 3 = 1 THEN 'complex_text' ELSE 'container' END AS geometry_mode,
  confidence * 0.9 AS source_ink_coverage, (1 - confidence) / 2 AS target_residual_ratio,
  CASE WHEN rid % 7 = 0 THEN '' WHEN kind = 'sfx' THEN NULL ELSE kind END AS reason
FROM {regions}""")

#: A page's run trace: a user's events.
TRACE = Relation("""SELECT event_id, user_id AS run, CAST(ts AS TIMESTAMP) AS ts, event_type AS stage, value, props FROM {events}""")

#: Every other region, as those already represented.
HALF = Relation("SELECT * FROM {regions} WHERE rid % 2 = 0")

#: Transfer records with the measures and contracts that their audit reads.
TRANSFERS = Relation("""
SELECT page, rid, kind, confidence, x0, y0, x1, y1, rid % 6 <> 0 AS applied, CASE rid % 5 WHEN 0 THEN 'not_checked' WHEN 1 THEN 'checked_ink' WHEN 2 THEN 'disabled' ELSE 'checked' END AS content_check,
  CAST(text_len AS INT) % 3 <> 0 AS content_complete, CAST(y0 AS INT) % 60 = 0 AS review_required, CAST(x0 AS INT) % 240 = 80 AS candidate,
  CASE CAST(text_len AS INT) % 7 WHEN 0 THEN 'photo_pair' WHEN 1 THEN 'complex_text' WHEN 2 THEN 'rigid_uniform_container' WHEN 3 THEN 'ocr_guided_components' ELSE 'standard' END AS geometry_mode,
  CASE WHEN rid % 12 = 0 THEN 'source_text_region_clipped_at_page_edge' WHEN kind = 'sfx' THEN NULL ELSE 'low_score' END AS reason, CASE WHEN rid % 4 = 0 THEN 'source_text_region_clipped_at_page_edge' ELSE '' END AS review_reason,
  CASE WHEN rid % 3 = 0 THEN 'diff-src-' ELSE 'bubble-' END AS prefix, concat(CASE WHEN rid % 3 = 0 THEN 'diff-src-' ELSE 'bubble-' END, CAST(rid AS STRING)) AS source_id, concat('target-', CAST(rid AS STRING)) AS target_id,
  CASE CAST(x1 AS INT) % 6 WHEN 0 THEN 'ink-reconstruction' WHEN 1 THEN 'photo-crisp-ink' WHEN 2 THEN 'locked-source-container-patch' WHEN 3 THEN 'complex-text-ink-transfer' ELSE 'pixels' END AS clarity_mode,
  confidence AS mask_iou, 0.9 + confidence / 10 AS target_coverage, (1 - confidence) / 3 AS spill_ratio, 1 + CAST(CAST(x1 AS INT) % 40 AS DOUBLE) / 10 AS sr_scale, CAST(CAST(y1 AS INT) % 37 AS DOUBLE) AS sharpness,
  CASE WHEN rid % 9 = 4 THEN 'rigid-container-raster' ELSE 'resample' END AS backend, rid % 2 = 0 AS integrity_contract, CAST(y1 AS INT) % 5 = 0 AS glyph_dense_warp,
  rid % 4 <> 3 AS has_contract, CAST(x1 AS INT) % 9 <> 0 AS source_on_top, CAST(y1 AS INT) % 8 <> 0 AS border_removed, rid % 2 = 1 AS axis_locked, CASE WHEN CAST(x1 AS INT) % 7 = 0 THEN -0.5 ELSE 0.0 END AS rotation_deg,
  CAST(x1 AS INT) % 3 - 1 AS shift_dx, CASE WHEN CAST(x1 AS INT) % 3 = 1 THEN CAST(y1 AS INT) % 2 ELSE 0 END AS shift_dy, confidence * 1.4 AS relative_sharpness
FROM {regions} WHERE page % 11 <> 0 AND rid % 7 <> 5""")

#: Recognised source units: every page but each fourth has them.
UNITS = Relation("SELECT page, rid, confidence, kind, text_len FROM {regions} WHERE page % 4 <> 1 AND rid % 3 <> 2")

#: Layout items: a label for each kind, and text inside every other bubble.
ITEMS = Relation("""
SELECT page, rid, x0, y0, x1, y1, confidence, CASE kind WHEN 'speech' THEN 'bubble' WHEN 'narration' THEN 'text' WHEN 'sfx' THEN 'sfx' ELSE 'panel' END AS label FROM {regions}
UNION ALL SELECT page, rid + 100, x0 + 3, y0 + 3, x1 - 3, y1 - 3, 0.99 - confidence / 4, 'text' FROM {regions} WHERE kind = 'speech' AND rid % 2 = 0""")

#: The clear mask of a page, and what stays dark in it.
CLEAR = Relation("SELECT o_orderkey AS page, o_custkey % 5 * 100 AS source_pixels, CAST(o_custkey % 40 AS DOUBLE) / 100 AS clipped_ratio FROM {orders}")
RESIDUAL = Relation("SELECT page, rid, CAST(CAST(x1 AS INT) % 17 AS DOUBLE) / 100 AS dark_ratio FROM {regions}")

#: Pages as photographed pairs.
PHOTO_PAGES = Relation("""
SELECT o_orderkey AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'raw_diff' ELSE 'photo_pair' END AS method, CASE WHEN o_custkey % 2 = 0 THEN 'mask_replace' ELSE 'hybrid' END AS mode, CAST(45 + o_custkey % 56 AS DOUBLE) / 100 AS registration_confidence,
  o_custkey % 3 * 2 AS source_blocks, o_custkey % 5 AS target_blocks FROM {orders}""")

#: Runs of pages, and the files they left.
RUNS = Relation("""
SELECT o_orderkey AS page, CASE o_orderkey % 7 WHEN 0 THEN 'direct_patch' WHEN 1 THEN 'mask_replace' WHEN 2 THEN 'aligned_overlay_reveal' WHEN 3 THEN 'transparent_bubble_reveal' WHEN 4 THEN 'hybrid' WHEN 5 THEN 'reletter' ELSE 'auto' END AS mode,
  CASE o_custkey % 5 WHEN 0 THEN 'direct_patch' WHEN 1 THEN 'passthrough' WHEN 2 THEN '' WHEN 3 THEN 'direct_reject' ELSE 'mask_replace' END AS strategy, CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'hybrid' ELSE CASE o_orderkey % 7 WHEN 0 THEN 'direct_patch' WHEN 1 THEN 'mask_replace' WHEN 2 THEN 'aligned_overlay_reveal' WHEN 3 THEN 'transparent_bubble_reveal' WHEN 4 THEN 'hybrid' WHEN 5 THEN 'reletter' ELSE 'auto' END END AS project_mode,
  CASE o_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'broken' ELSE 'read' END AS receipt, CASE WHEN o_orderkey % 8 = 3 THEN 'old' ELSE 'pagewright.run_receipt.v1' END AS receipt_schema,
  CASE WHEN o_custkey % 6 = 1 THEN ' Hybrid ' ELSE CASE o_orderkey % 7 WHEN 0 THEN 'direct_patch' WHEN 1 THEN 'mask_replace' WHEN 2 THEN 'aligned_overlay_reveal' WHEN 3 THEN 'transparent_bubble_reveal' WHEN 4 THEN 'hybrid' WHEN 5 THEN 'reletter' ELSE 'auto' END END AS receipt_mode,
  CASE WHEN o_custkey % 4 = 1 THEN 'reletter' WHEN o_custkey % 4 = 2 THEN NULL ELSE CASE o_orderkey % 7 WHEN 0 THEN 'direct_patch' WHEN 1 THEN 'mask_replace' WHEN 2 THEN 'aligned_overlay_reveal' WHEN 3 THEN 'transparent_bubble_reveal' WHEN 4 THEN 'hybrid' WHEN 5 THEN 'reletter' ELSE 'auto' END END AS receipt_project_mode,
  CASE WHEN o_custkey % 7 = 2 THEN 'mask_replace' ELSE '' END AS receipt_strategy, CASE WHEN o_orderkey % 13 = 5 THEN false WHEN o_orderkey % 13 = 6 THEN NULL ELSE true END AS receipt_passed,
  CASE WHEN o_custkey % 13 = 5 THEN false END AS execution_passed, o_custkey % 17 <> 3 AS isolation_passed, o_orderkey % 5 = 0 AS direct_used, o_orderkey % 5 = 1 AS mask_used, o_orderkey % 5 = 2 AS hybrid_used, o_orderkey % 3 AS hybrid_texts, o_orderkey % 4 AS reletter_texts
FROM {orders}""")
FILE_NAMES = (
    "final.png", "target_original.png", "direct_patch_layer.png", "mask_transfer_layer.png", "mask_transfer_mask.png", "hybrid_transfer_layer.png", "hybrid_text_layer.png", "reletter_text_layer.png", "project.json", "qa.json",
    "transfer_audit.json", ".final.png.x1.tmp", "aligned_overlay_reveal.json", "transparent_bubble_reveal.json", "clear_mask.png",
)
FILES = Relation(
    "SELECT o_orderkey AS page, v.name AS name, (o_orderkey + v.n) % 19 <> 7 AS readable, 800 + CASE WHEN (o_orderkey + v.n) % 23 = 1 THEN 1 ELSE 0 END AS width, 1100 AS height FROM {orders} o JOIN (SELECT * FROM (VALUES "
    + ", ".join(f"('{name}', {n})" for n, name in enumerate(FILE_NAMES))
    + ") AS t(name, n)) v ON (o_orderkey * 7 + v.n * 5) % (v.n + 3) <> 1"
)

_MODE = "CASE o_orderkey % 7 WHEN 0 THEN 'direct_patch' WHEN 1 THEN 'mask_replace' WHEN 2 THEN 'aligned_overlay_reveal' WHEN 3 THEN 'transparent_bubble_reveal' WHEN 4 THEN 'hybrid' WHEN 5 THEN 'reletter' ELSE 'auto' END"

#: Raw labels of parts, under several writings.
LABELLED = Relation("SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN ' Sound-Effect ' WHEN 1 THEN 'speech-bubble' WHEN 2 THEN 'Onomatopoeia' WHEN 3 THEN 'sound_effect' WHEN 4 THEN NULL WHEN 5 THEN 'Aside-Text' ELSE 'panel' END AS label FROM {part}")
#: Layout authority with whether what it says nothing of may pass.
AUTHORITY_ROWS = Relation("SELECT a.*, page % 3 <> 0 AS allow_unknown FROM {authority} a")
#: Proposals of changed regions: a source and a target region each; some name a region that isn't there.
PROPOSALS = Relation("SELECT page, rid AS record, rid AS source, CASE WHEN rid % 8 = 7 THEN -1 ELSE rid END AS target, page % 10 <> 3 AS source_available, page % 10 <> 4 AS target_available FROM {regions}")
KINDED = Relation("SELECT a.*, CASE kind WHEN 'sfx' THEN 'free_text' WHEN 'unknown' THEN 'plugin' ELSE 'bubble' END AS region_kind FROM {authority} a")
#: Candidates of two groups.
GROUPED = Relation("SELECT page, rid, 0 AS grp FROM {regions} WHERE rid % 3 <> 1 UNION ALL SELECT page, rid, 1 FROM {regions} WHERE rid % 2 = 0")
#: Text blocks with the bubble that recognition gave them.
BLOCKS = Relation("SELECT page, rid, x0, y0, x1, y1, confidence, CASE WHEN page % 4 = 2 THEN 0 ELSE text_len END AS text_len, CASE WHEN rid % 2 = 0 THEN rid END AS bubble_id FROM {regions}")
READ_PAGES = Relation("SELECT o_orderkey AS page, CASE o_custkey % 6 WHEN 0 THEN ' None ' WHEN 1 THEN NULL ELSE 'engine' END AS backend, CASE WHEN o_custkey % 7 = 2 THEN 'skipped_mode' ELSE 'cache' END AS route, o_orderkey % 2 = 0 AS region_text_only FROM {orders}")
#: Layouts of text before and after.
PROFILES = Relation("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'vertical' ELSE 'horizontal' END AS orientation, 1 + o_custkey % 5 AS s_columns, 1 + o_custkey % 4 AS t_columns, 1 + o_custkey % 7 AS s_rows, 1 + o_custkey % 6 AS t_rows,
  0.3 + CAST(o_custkey % 7 AS DOUBLE) / 10 AS s_fill_x, 0.3 + CAST(o_orderkey % 6 AS DOUBLE) / 10 AS t_fill_x, 0.4 + CAST(o_orderkey % 5 AS DOUBLE) / 10 AS s_fill_y, 0.3 + CAST(o_custkey % 6 AS DOUBLE) / 10 AS t_fill_y, CAST(o_custkey % 30 AS DOUBLE) AS s_pitch, CAST(o_orderkey % 25 AS DOUBLE) AS t_pitch FROM {orders}""")
DIRECT_PLANS = Relation("SELECT o_orderkey AS page, o_custkey % 3 AS border_pixels, o_custkey % 4 = 0 AS ocr_used, o_custkey % 5 = 0 AS bubble_matching_used, o_custkey % 6 <> 0 AS present FROM {orders}")
#: Stored marks of pages, old and odd ones among them.
MARK_FACTS = Relation("""
SELECT concat('page-', CAST(o_orderkey AS STRING)) AS key, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('target-', CAST(o_custkey AS STRING)) END AS target_name, CASE o_orderkey % 9 WHEN 0 THEN 'cover' WHEN 1 THEN 'auto_no_text' WHEN 2 THEN '' WHEN 3 THEN 'poster' WHEN 4 THEN 'blank' WHEN 5 THEN NULL WHEN 6 THEN 'skip' ELSE 'content' END AS page_type,
  CASE o_orderkey % 5 WHEN 0 THEN 'manual' WHEN 1 THEN '' ELSE 'auto' END AS origin, CASE WHEN o_orderkey % 2 = 0 THEN 'given' END AS reason FROM {orders} WHERE o_orderkey % 6 < 2""")
NAMED_PAGES = Relation("SELECT o_orderkey AS page, concat('page-', CAST(o_orderkey AS STRING)) AS key, concat('target-', CAST(o_custkey AS STRING)) AS target_name FROM {orders}")
FURTHER = Relation("SELECT page, CASE WHEN rid % 2 = 0 THEN 'free_text' ELSE kind END AS kind FROM {regions} WHERE page % 5 = 0 AND rid % 3 = 0")
FIRST = Relation("SELECT page, CASE WHEN kind = 'sfx' OR page % 6 = 1 THEN 'free_text' ELSE kind END AS kind FROM {regions} WHERE page % 7 <> 2")
PROBED = Relation("SELECT p.*, page % 2 = 0 AS skip_asked FROM {pages} p")
CACHED = Relation("""
SELECT o_orderkey AS page, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'default' WHEN 2 THEN 'manual' ELSE 'auto' END AS origin, CASE o_custkey % 3 WHEN 0 THEN 'cover' WHEN 1 THEN 'content' ELSE 'blank' END AS page_type, o_custkey % 3 = 1 AS processed, o_orderkey % 3 = 0 AS passthrough,
  CASE WHEN o_custkey % 2 = 0 THEN 'source_no_transferable_text' ELSE 'marked' END AS passthrough_reason, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'cover' ELSE 'blank' END AS cached_type FROM {orders}""")
PLANNED = Relation(f"SELECT o_orderkey AS page, {_MODE} AS mode, o_custkey % 5 <> 0 AS same_page, o_custkey % 3 <> 0 AS direct_available, o_custkey % 2 = 0 AS direct_safe, o_custkey % 7 = 0 AS secondary_available, o_custkey % 14 = 0 AS secondary_selected, o_orderkey % 2 = 0 AS aligned_available, o_orderkey % 4 = 0 AS aligned_allowed FROM {{orders}}")
UNIT_FACTS = Relation("SELECT page, rid, CASE WHEN rid % 4 = 0 THEN concat('b', CAST(rid AS STRING)) WHEN rid % 4 = 1 THEN ' ' END AS bubble_id, CASE rid % 3 WHEN 0 THEN ' Bubble ' WHEN 1 THEN 'text_block' END AS geometry, CASE WHEN rid % 5 = 0 THEN 'Dialogue' ELSE kind END AS kind FROM {regions}")
RESCUES = Relation("""
SELECT m.page AS page, m.source AS source, m.target AS target, CASE m.page % 3 WHEN 0 THEN 'reletter' WHEN 1 THEN 'hybrid' ELSE 'direct_patch' END AS mode, m.route AS route, m.confidence AS confidence, p.registration_confidence AS registration_confidence,
  CASE WHEN m.source % 5 <> 0 THEN m.source END AS source_bubble, m.target AS target_bubble, m.source % 2 = 0 AS source_recovered FROM {matches} m JOIN {pages} p ON p.page = m.page""")
#: Layout's verdict on the regions of a side, as far apart as rescue needs.
VERDICTS = Relation("SELECT page, rid, CASE (rid + page) % 3 WHEN 0 THEN 'PROTECT' WHEN 1 THEN 'ALLOW' ELSE 'UNKNOWN' END AS state, CASE WHEN (rid + page) % 3 = 0 THEN 'panel_only' ELSE 'layout_support' END AS reason, confidence AS bubble, confidence / 2 AS text, confidence / 3 AS sfx, 1 - confidence AS panel FROM {regions}")
FAR_VERDICTS = Relation("SELECT page, rid, CASE (rid + page) % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'PROTECT' ELSE 'ALLOW' END AS state, CASE WHEN (rid + page) % 3 = 1 THEN 'panel_only' ELSE 'layout_support' END AS reason, confidence AS bubble, confidence / 2 AS text, confidence / 3 AS sfx, 1 - confidence AS panel FROM {regions}")
SETTINGS = Relation("SELECT o_orderkey AS page, CASE o_custkey % 4 WHEN 0 THEN 'MangaLens' WHEN 1 THEN 'other' WHEN 2 THEN ' rtdetr_v2 ' END AS first, CASE o_custkey % 5 WHEN 0 THEN 'seeded_white' WHEN 1 THEN 'sidecar' WHEN 2 THEN 'sam2' WHEN 3 THEN 'none' END AS legacy, CASE o_orderkey % 4 WHEN 0 THEN 'Primary_Only' WHEN 1 THEN 'primary_plus_aux' WHEN 2 THEN 'odd' END AS strategy, o_custkey % 2 = 0 AS sufficient FROM {orders}")
ASKED_DETECTORS = Relation("SELECT o.o_orderkey AS page, v.name AS name, v.place AS place FROM {orders} o JOIN (SELECT * FROM (VALUES ('geometry_white', 3), ('Mangalens', 1), ('rtdetr_v2', 2), ('unknown', 4), ('sidecar', 5), ('mangalens', 6), ('sam2', 7)) AS t(name, place)) v ON (o.o_orderkey + v.place) % 3 <> 0")
REVIEWS = Relation(f"SELECT o_orderkey AS page, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Hybrid ' ELSE {_MODE} END AS owner, {_MODE} AS requested, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS markers, CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 0 END AS rows, CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS maps, CASE o_custkey % 13 WHEN 0 THEN 'force_mask_replace' WHEN 1 THEN ' ' END AS forced FROM {{orders}}")
SEEN_PAGES = Relation("SELECT o_orderkey AS page, o_custkey % 4 AS source_bubbles, o_custkey % 3 AS target_bubbles FROM {orders}")
COUNTERS = Relation(f"SELECT o_orderkey AS page, CASE WHEN o_custkey % 5 = 0 THEN 4 END AS applied_count, CASE WHEN o_custkey % 5 = 1 THEN 3 END AS successful_regions, CASE WHEN o_custkey % 10 = 2 THEN 2 END AS accepted_count, CASE WHEN o_custkey % 10 = 7 THEN 1 END AS region_count, CASE WHEN o_custkey % 3 = 0 THEN 1 END AS failed_regions, CASE WHEN o_custkey % 4 = 0 THEN 2 END AS failed_count, CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'hybrid' ELSE {_MODE} END AS old_mode, {_MODE} AS mode FROM {{orders}}")
#: Sizes are whole numbers nearest to prices, halves to even, as a cast gives them in the other engine (here a cast would cut).
SIZED_PAGES = Relation(
    "SELECT o_custkey AS book, o_orderkey AS page, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(rint(o_totalprice) AS BIGINT) % 40000 END AS bytes FROM {orders}",
    "SELECT o_custkey AS book, o_orderkey AS page, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS BIGINT) % 40000 END AS bytes FROM {orders}",
)
SIXTEEN = Relation("SELECT r_regionkey * 4 + n AS k FROM {region} r JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(n)) v ON r_regionkey < 4")
RESULT_FILES = Relation("SELECT o.o_orderkey AS page, v.role AS role, concat(v.name, CAST(o.o_orderkey AS STRING)) AS path, v.place AS place, (o.o_orderkey + v.place) % 4 <> 0 AS present, (o.o_custkey * v.place) % 3 AS modified FROM {orders} o CROSS JOIN (SELECT * FROM (VALUES ('reviewed', 'final_reviewed', 0), ('automatic', 'final', 1), ('reviewed', 'art_reviewed', 2), ('automatic', 'art_final', 3), ('book', 'book_final', 4)) AS t(role, name, place)) v")
FOLDERS = Relation("SELECT o.o_orderkey AS page, concat(v.name, '/', CAST(o.o_orderkey AS STRING)) AS folder, v.place AS place, (o.o_orderkey * 3 + v.place) % 5 = 0 AS present FROM {orders} o CROSS JOIN (SELECT * FROM (VALUES ('named', 0), ('own', 1), ('plain', 2), ('old', 3)) AS t(name, place)) v")
OWN_FOLDERS = Relation("SELECT o_orderkey AS page, concat('own/', CAST(o_orderkey AS STRING)) AS own FROM {orders}")
ODD_PAGES = Relation("SELECT page, registration_confidence, CASE WHEN page % 17 = 3 THEN CAST('NaN' AS DOUBLE) WHEN page % 17 = 4 THEN CAST('Infinity' AS DOUBLE) ELSE reprojection_error END AS reprojection_error, inlier_ratio FROM {pages}")
DETECTED = Relation("SELECT page, rid, confidence, CASE rid % 6 WHEN 0 THEN 'koharu_layout' WHEN 1 THEN 'seeded_white' WHEN 2 THEN 'contour' WHEN 3 THEN ' SAM2 ' WHEN 4 THEN NULL ELSE 'text_seed_white_rect' END AS backend, rid % 4 = 0 AS has_text_box FROM {regions}")
TAGGED = Relation("SELECT page, rid, confidence, CASE WHEN rid % 2 = 0 THEN 'sam2' ELSE 'mangalens' END AS backend FROM {regions}")
CANDIDATES = Relation("""
SELECT page, 'similarity' AS method, 0 AS place, inlier_ratio * 0.96 AS inlier_ratio, reprojection_error + 0.4 AS error, spatial_coverage AS coverage FROM {pages}
UNION ALL SELECT page, 'affine', 1, inlier_ratio * 0.98, reprojection_error + 0.2, spatial_coverage FROM {pages} UNION ALL SELECT page, 'homography', 2, inlier_ratio, reprojection_error, spatial_coverage * 0.9 FROM {pages}""")
SOURCES = Relation("""
SELECT book, page, page % 2 = 1 AS is_secondary, CAST(page % 6 AS BIGINT) AS applied, CAST(page % 8 AS BIGINT) AS candidates, page % 9 <> 0 AS plan_safe, pair_confidence AS same_page, registration_confidence AS registration, reprojection_error AS reprojection,
  CASE WHEN page % 5 <> 0 THEN CAST(page % 60 AS DOUBLE) / 10 END AS boundary, CAST(page % 400 AS DOUBLE) AS sharpness, CAST(page % 3 AS BIGINT) AS risks FROM {pages}""")
CHANGES = Relation("SELECT s.page AS page, s.rid AS rid, p.registration_confidence AS registration_confidence, s.confidence AS mask_iou, (s.x1 - s.x0) / 200 AS density, (s.y1 - s.y0) / 400 AS source_ink, s.text_len / 200 AS target_ink FROM {regions} s JOIN {pages} p ON p.page = s.page")
GROUPS = Relation("SELECT page, rid, x0, y0, x1, y1, CAST(text_len AS INT) AS glyphs, 14 + text_len AS glyph_w, 12 + text_len AS glyph_h, (x1 - x0) * 0.8 AS span_x, (y1 - y0) * 1.7 AS span_y FROM {regions}")
ACTIONS = Relation("SELECT page, rid AS id, CASE rid % 5 WHEN 0 THEN 'region_brush_reveal' WHEN 1 THEN 'reveal_text' ELSE ' Region_mask' END AS mode, CAST(x1 AS INT) % 4 AS box, CAST(y1 AS INT) % 2 AS settings FROM {regions}")

#: Marks of time and states of a run.
CLICKS = Relation("SELECT run, event_id, ts FROM {trace} t WHERE event_id % 3 = 0")
STATES = Relation("SELECT run, ts, stage FROM {trace} t WHERE event_id % 3 <> 0")

#: Bubbles that name a partner of the other side, some of them.
NAMING_SOURCE = Relation("SELECT r.*, CASE WHEN page % 4 = 1 OR rid % 3 = 0 THEN NULL ELSE rid END AS paired_id FROM {regions} r")
NAMING_TARGET = Relation("SELECT r.*, CASE WHEN page % 4 = 1 OR rid % 2 = 0 THEN NULL ELSE rid + rid % 4 - 1 END AS paired_id FROM {regions} r")
HANDLED = Relation("SELECT page, rid FROM {records} r WHERE applied AND page % 4 <> 1")
#: Text regions of a page's largest extent, as if it were one bubble.
IN_BUBBLE = Relation("""
SELECT r.page AS page, r.rid AS rid, r.x0 AS x0, r.y0 AS y0, r.x1 AS x1, r.y1 AS y1, CASE WHEN r.y1 - r.y0 > r.x1 - r.x0 THEN 'vertical' ELSE 'horizontal' END AS orientation, CAST(r.text_len AS BIGINT) AS parts, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1
FROM {regions} r JOIN (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {regions} GROUP BY page) b ON b.page = r.page""")
LISTED = Relation("SELECT DISTINCT page, block AS rid FROM {assigned} a WHERE region IS NOT NULL")
WANTED = Relation("SELECT o_orderkey AS page, concat('v', CAST(o_custkey % 5 AS STRING)) AS signature FROM {orders} o")
CACHED_ROWS = Relation("SELECT o_orderkey AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'v0' ELSE concat('v', CAST(o_custkey % 5 AS STRING)) END AS signature, o_orderkey % 4 AS bubbles FROM {orders} o WHERE o_orderkey % 6 <> 5")
ANCHORS = Relation("SELECT book, source, target FROM (SELECT o_custkey AS book, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 3 - 1 AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 3 - 1 + o_custkey % 2 AS target, o_orderkey % 4 AS k FROM {orders} o) x WHERE k = 0")
BOOK_SIZES = Relation("SELECT o_custkey AS book, count(*) * 3 + 2 AS n, count(*) * 3 + 3 AS m FROM {orders} o GROUP BY o_custkey")

#: Review overrides of units.
OVERRIDES = Relation("SELECT page, rid, CASE WHEN page % 3 = 0 THEN 'force_match' ELSE 'skip_unit' END AS act, CASE WHEN page % 3 = 0 THEN rid END AS target FROM {regions} r WHERE rid % 4 = 1 AND page % 2 = 0")
DELETES = Relation("SELECT run, stage, ts FROM {trace} t WHERE event_id % 13 = 0")
#: Turns of conversations as recognised blocks, and a bubble for each pair of turns but the last ones.
TURNS = Relation("SELECT conv_id AS page, turn AS id, turn AS reading_order, CASE WHEN turn % 5 = 4 THEN NULL ELSE CAST(floor(turn / 2) AS BIGINT) END AS bubble_id, CASE WHEN turn % 7 = 3 THEN concat(text, 'あ', repeat('漢', 400)) ELSE text END AS text, CAST(50 + turn % 50 AS DOUBLE) / 100 AS confidence, CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE role END AS kind FROM {conversations} c")
TURN_BUBBLES = Relation("SELECT conv_id AS page, CAST(floor(turn / 2) AS BIGINT) AS id, CASE WHEN floor(turn / 2) % 2 = 0 THEN 'speech' ELSE 'narration' END AS kind FROM {conversations} c WHERE turn % 2 = 0 AND turn % 12 <> 6")
#: Fingerprints of pages: signs of neighbouring components as bits, made-up shapes, the components as edges.
PRINTS = Relation("""
SELECT vec_id AS id, aggregate(transform(sequence(0, 61), i -> CASE WHEN embedding[i] < embedding[i + 1] THEN shiftleft(1L, i) ELSE 0L END), 0L, (s, b) -> s | b) AS hash, CAST(500 + vec_id % 37 * 20 AS DOUBLE) / 1000 AS aspect, transform(embedding, x -> CAST(x AS DOUBLE)) AS edges,
  CAST(vec_id AS DOUBLE) / greatest(1, (SELECT max(vec_id) FROM {embeddings})) AS place FROM {embeddings} e""",
"""
SELECT vec_id AS id, list_sum(list_transform(range(0, 62), lambda i: CASE WHEN embedding[i + 1] < embedding[i + 2] THEN 1::BIGINT << i::INT ELSE 0::BIGINT END))::BIGINT AS hash, CAST(500 + vec_id % 37 * 20 AS DOUBLE) / 1000 AS aspect, embedding::DOUBLE[] AS edges,
  CAST(vec_id AS DOUBLE) / greatest(1, (SELECT max(vec_id) FROM {embeddings})) AS place FROM {embeddings} e""")  # fmt: skip
#: Texts to scan: documents, some with a planted secret or home folder, and made-up paths of files.
TEXTS = Relation("""
SELECT doc_id AS id, CASE doc_id % 25 WHEN 1 THEN concat(coalesce(text, ''), ' gh', 'p_', repeat('a1B2', 6)) WHEN 2 THEN concat('key AK', 'IA', repeat('Z9', 8), ' ', coalesce(text, '')) WHEN 3 THEN concat('x sk', '-ant-', repeat('q', 24)) WHEN 4 THEN concat('xsk', '-proj-', repeat('q', 24)) WHEN 5 THEN concat('a', chr(10), 'see /Us', 'ers/maria/x', chr(10), 'b')
  WHEN 6 THEN concat('regex /ho', 'me/maria/x') WHEN 7 THEN concat('at /ho', 'me/runner/x and /ho', 'me/jan', chr(10)) WHEN 8 THEN concat('-----BEGIN EC PRI', 'VATE KEY-----') WHEN 9 THEN concat('h', 'f_', repeat('k', 19)) ELSE text END AS text FROM {documents} d""")
PATHS = Relation("""
SELECT DISTINCT concat(CASE o_orderkey % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'Logs/' WHEN 2 THEN 'a/models/' WHEN 3 THEN 'catalogs/' WHEN 4 THEN '.Cache/weights/' ELSE '' END, CASE o_custkey % 11 WHEN 0 THEN '.env' WHEN 1 THEN '.env.example' WHEN 2 THEN 'my.environment' WHEN 3 THEN 'x.PEM' WHEN 4 THEN 'net.pt' WHEN 5 THEN 'credentials.json' WHEN 6 THEN '.key' WHEN 7 THEN 'run.log.txt' WHEN 8 THEN '.env.local'
  WHEN 9 THEN 'a.sqlite3' ELSE 'readme.md' END) AS path FROM {orders} o""")

_H = "1 + CAST(page % 7 AS DOUBLE) / 50 AS h00, CAST(page % 5 AS DOUBLE) / 40 AS h01, CAST(page % 11 AS DOUBLE) AS h02, -CAST(page % 3 AS DOUBLE) / 30 AS h10, 1 - CAST(page % 4 AS DOUBLE) / 60 AS h11, CAST(page % 13 AS DOUBLE) - 5 AS h12, CAST(page % 6 AS DOUBLE) / 100000 AS h20, CAST(page % 2 AS DOUBLE) / 90000 AS h21, 1.0 AS h22"
#: Points and boxes with the homography of their page.
POINTS = Relation(f"SELECT page, rid, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, {_H} FROM {{regions}} r")
WARPED = Relation(f"SELECT page, rid, x0, y0, x1, y1, {_H} FROM {{regions}} r")
SELECTED = Relation("SELECT page, rid, CASE WHEN rid % 3 = 0 THEN x1 + 0.5 ELSE x0 - 700.5 * (rid % 2) END AS px, y0 + 0.5 AS py, CASE WHEN rid % 4 = 0 THEN x0 + 1.2 ELSE x1 END AS qx, y1 * (rid % 2 + 0.4) AS qy, CAST(text_len AS INT) * 3 AS diameter FROM {regions} r")
DIRECTED = Relation("SELECT page, rid, x0, y0, x1, y1, CASE rid % 5 WHEN 0 THEN 'vertical' WHEN 1 THEN 'horizontal' ELSE 'auto' END AS base FROM {regions} r")
HINTED = Relation("SELECT page, CASE WHEN rid > 2 THEN rid - rid % 3 ELSE rid END AS unit, rid, x0, y0, x1, y1, CASE rid % 7 WHEN 3 THEN 'Vertical' WHEN 5 THEN 'odd' END AS hint FROM {regions} r")
#: Short texts of several kinds.
PHRASES = Relation("SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN '...!?' WHEN 1 THEN 'Mode (fast) name （x） end' WHEN 2 THEN concat(' two', chr(13), chr(10), 'lines', chr(13), 'x ') WHEN 3 THEN 'Page 12 (3)' WHEN 4 THEN 'pairing=order' WHEN 5 THEN '漢字と かな' WHEN 6 THEN '' WHEN 7 THEN 'ｱｲ' ELSE p_name END AS text FROM {part} p")
CONTENTS = Relation("SELECT doc_id AS id, concat('page-', CAST(doc_id AS STRING), '.png') AS name, coalesce(text, '') AS content FROM {documents} d")
#: Settings by namespace, and the signatures of a page's two files.
CONFIG = Relation("SELECT v.namespace AS namespace, concat(v.namespace, '.', k.name) AS name, concat('\"', v.namespace, '-', k.name, '\"') AS value FROM (SELECT * FROM (VALUES ('page_management'), ('pairing'), ('registration'), ('qa'), ('direct_patch'), ('mask_replace'), ('hybrid'), ('reletter'), ('ocr'), ('bubbles'), ('matching'), ('masking'), ('batch'), ('transparent_bubble_reveal')) AS t(namespace)) v CROSS JOIN (SELECT * FROM (VALUES ('smart_alignment_band'), ('enabled'), ('level')) AS t(name)) k WHERE (SELECT count(*) FROM {region}) > 0")
FILE_PAIRS = Relation("SELECT o_orderkey AS page, concat('s', CAST(o_custkey % 50 AS STRING)) AS source, concat('t', CAST(o_orderkey % 60 AS STRING)) AS target FROM {orders} o")
RESUMED = Relation("SELECT r.*, page % 3 = 0 AS lenient FROM {runs} r")
FINISHED_JOBS = Relation("SELECT s.page AS page, CASE WHEN s.page % 5 = 0 THEN 'old' ELSE s.job END AS job, CASE WHEN s.page % 11 = 0 THEN '' WHEN s.page % 13 = 0 THEN 'other' ELSE r.mode END AS mode, s.page % 2 = 0 AS same_files, s.page % 4 = 0 AS touched, s.page % 17 <> 0 AS has_result FROM {signatures} s JOIN {runs} r ON r.page = s.page WHERE s.page % 7 <> 3")

#: Files of folders as a listing would give them, and sessions of outputs.
LISTING = Relation("SELECT concat('d', CAST(o_custkey % 20 AS STRING), '/', concat(CASE o_orderkey % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'scan 1' ELSE 'notes' END, CASE WHEN o_orderkey % 5 = 0 THEN ' (2)' ELSE '' END, CASE WHEN o_orderkey % 4 = 3 THEN 'x' ELSE '' END), '.', CASE WHEN o_orderkey % 2 = 0 THEN 'md' ELSE 'json' END) AS path, concat('d', CAST(o_custkey % 20 AS STRING)) AS folder, concat(CASE o_orderkey % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'scan 1' ELSE 'notes' END, CASE WHEN o_orderkey % 5 = 0 THEN ' (2)' ELSE '' END, CASE WHEN o_orderkey % 4 = 3 THEN 'x' ELSE '' END) AS stem, CASE WHEN o_orderkey % 2 = 0 THEN 'md' ELSE 'json' END AS ending FROM {orders} o")
FILES_ONCE = Relation("SELECT DISTINCT path, folder, stem, ending FROM {listing} l")
IMAGES = Relation("SELECT o_orderkey AS page_id, o_custkey AS folder, lpad(CAST(o_orderkey % 1000 AS STRING), 12, '0') AS sort_key, 1 + o_custkey % 3 AS start_page FROM {orders} o")
MANIFESTS = Relation("SELECT o.o_orderkey AS page, concat('alt', CAST(v.place AS STRING)) AS path, CASE WHEN v.place = 1 THEN 'remake' END AS kind, v.place AS place, (o.o_orderkey + v.place) % 3 <> 0 AS present FROM {orders} o CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(place)) v")
LOOKED_FOR = Relation("SELECT o.o_orderkey AS page, concat(CASE WHEN v.place < 3 THEN 'd1/scan' ELSE 'd2/notes' END, CASE WHEN o.o_orderkey % 2 = 0 THEN 'x' ELSE '' END) AS stem, v.ending AS ending, v.place AS place FROM {orders} o CROSS JOIN (SELECT * FROM (VALUES ('png', 0), ('json', 1), ('md', 2), ('json', 3), ('md', 4)) AS t(ending, place)) v")
SESSION = Relation("""
SELECT o_custkey AS session, concat('page', CAST(o_orderkey AS STRING)) AS page_id, concat('in/', CAST(o_orderkey AS STRING)) AS project_source, o_orderkey % 3 = 0 AS project_source_there, concat('out/', CAST(o_orderkey AS STRING)) AS project_target, o_orderkey % 4 = 0 AS project_target_there, o_orderkey % 5 <> 0 AS source_original,
  o_orderkey % 2 = 0 AS source_authority, o_orderkey % 7 <> 0 AS target_original, o_custkey % 4 AS source_index, o_orderkey % 3 AS target_index, o_orderkey % 6 = 1 AS failed, CASE WHEN o_orderkey % 8 <> 0 THEN 'final.png' END AS final FROM {orders} o""")
RESTORED_PAIRS = Relation("SELECT o_custkey AS session, concat('s', CAST(o_orderkey AS STRING)) AS source, concat('t', CAST(o_orderkey AS STRING)) AS target FROM {orders} o WHERE o_orderkey % 3 <> 0")
FOLDER_PAIRS = Relation("SELECT o_custkey AS session, concat('s', CAST(o_orderkey AS STRING)) AS source, concat('t', CAST(o_orderkey AS STRING)) AS target FROM {orders} o WHERE o_custkey % 2 = 0 OR o_orderkey % 7 = 0")
