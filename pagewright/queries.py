"""The registered queries for the engine's own operators, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as geo
from .functions import text as T
from .operators import audits as D
from .operators import expressions as E
from .operators import grouped as G
from .operators import matching as M
from .operators import pairing as N
from .operators import policies as P
from .operators import regions as R
from .operators import relational as B
from .operators import rules as U
from .operators import sequences as S
from .plans import adapters as A
from .plans.relation import Relation
from .sources import projects as J
from .streaming import history as H


class Plan:
    """An operator with the plans of its inputs; a plain string is a table of the data folder.

    A ``shared`` plan feeds several operators of a query: its rows are kept (in memory, then on
    disk) instead of being planned and computed once for each; a lost part is computed again.
    """

    def __init__(self, op: Relation, shared: bool = False, **inputs: Plan | str):
        self.op, self.shared, self.inputs = op, shared, inputs

    def frame(self, spark: SparkSession, sf_dir: str, made: dict[int, DataFrame] | None = None) -> DataFrame:
        made = {} if made is None else made
        if id(self) not in made:

            def of(source: Plan | str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{source}.parquet") if isinstance(source, str) else source.frame(spark, sf_dir, made)

            df = self.op(**{k: of(v) for k, v in self.inputs.items()})
            made[id(self)] = df.persist(StorageLevel.MEMORY_AND_DISK) if self.shared else df
        return made[id(self)]

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The frame with all whole numbers as long, as window functions give them in other engines."""
        df = self.frame(spark, sf_dir)
        return df.select(*(df[c].cast("long").alias(c) if t == "int" else df[c] for c, t in df.dtypes))

    def other(self) -> str:
        """The nested text for another engine."""
        return self.op.text(**{k: v if isinstance(v, str) else v.other() for k, v in self.inputs.items()})


source, target, pages, trace = Plan(A.SOURCE_REGIONS, lineitem="lineitem"), Plan(A.TARGET_REGIONS, lineitem="lineitem"), Plan(A.PAGES, orders="orders"), Plan(A.TRACE, events="events")
records = Plan(A.RECORDS, regions=source)
sides = {"source": source, "target": target}
costs = Plan(R.COSTS, **sides, pages=pages)
best = Plan(R.BEST, costs=costs)
matches = Plan(M.MATCHES, costs=costs)
sure = Plan(M.ONE_TO_ONE, matches=matches)
lettering = Plan(U.LETTERING, target=target)
findings = Plan(M.FINDINGS, pages=pages, matches=matches, lettering=lettering, **sides)
issues = Plan(M.ISSUES, findings=findings)
accepted = Plan(M.ACCEPTED, findings=findings)
summary = Plan(U.SUMMARY, issues=issues)
authority = Plan(R.AUTHORITY, regions=source, items=target)
triaged = Plan(U.TRIAGED, records=records)
numbers = Plan(S.PAGE_NUMBERS, pages="pages")
names = Plan(S.PAGE_NAMES, pages="pages")
by_number = Plan(S.UNIQUE_KEYS, source=numbers, target=numbers)
by_name = Plan(S.UNIQUE_KEYS, source=names, target=names)
history = Plan(S.HISTORY, trace=trace)
turns = Plan(A.TURNS, conversations="conversations")
prints = Plan(S.FINGERPRINTS, documents="documents")
finished = Plan(S.FINISHED, fingerprints=prints)
fingerprint_costs = Plan(S.FINGERPRINT_COST, prints=Plan(A.PRINTS, embeddings="embeddings"))

transfers, recognised, items = Plan(A.TRANSFERS, regions=source), Plan(A.UNITS, regions=source), Plan(A.ITEMS, regions=target)
runs, files = Plan(A.RUNS, orders="orders"), Plan(A.FILES, orders="orders")
leaks = Plan(D.LEAKS, files=files, runs=runs)
integrity = Plan(D.INTEGRITY, files=files, runs=runs, leaks=leaks)
audited = {"pages": pages, "records": transfers, "units": recognised, "bubbles": source}

by_order = lambda adapter, **more: Plan(adapter, orders="orders", **more)
of_source = lambda adapter: Plan(adapter, regions=source)
kinded = {"source": Plan(A.KINDED, authority=Plan(R.AUTHORITY, regions=source, items=target)), "target": Plan(A.KINDED, authority=Plan(R.AUTHORITY, regions=target, items=target))}
proposals = of_source(A.PROPOSALS)
blocks = of_source(A.BLOCKS)
transferable = Plan(P.TRANSFERABLE, blocks=blocks, bubbles=target, candidates=target)
direct_plans = by_order(A.DIRECT_PLANS)
marks = Plan(P.MARK_ROWS, marks=by_order(A.MARK_FACTS))
region_counts = Plan(P.REGION_COUNTS, first=of_source(A.FIRST), further=of_source(A.FURTHER))
settings = by_order(A.SETTINGS)
paired = Plan(R.PAIRED_IDS, pages=pages, **sides)
sources = Plan(P.SOURCE_EVIDENCE, sources=Plan(A.SOURCES, pages=pages))

naming = {"source": of_source(A.NAMING_SOURCE), "target": Plan(A.NAMING_TARGET, regions=target)}
named = Plan(N.NAMED_BUBBLES, **naming)
region_costs = Plan(N.REGION_COSTS, source=of_source(A.IN_BUBBLE), target=Plan(A.IN_BUBBLE, regions=target))
assigned_blocks = Plan(R.ASSIGNED, blocks=target, regions=source)

scoped = Plan(E.SCOPED_SETTINGS, runs=runs, settings=Plan(A.CONFIG, region="region"))
signatures = Plan(E.JOB_SIGNATURES, pairs=by_order(A.FILE_PAIRS), scoped=scoped)

listing = Plan(A.FILES_ONCE, listing=by_order(A.LISTING))

PLANS: dict[str, Plan] = {
    "page_region_match_summary": Plan(M.MATCH_SUMMARY, pages=pages, findings=findings),
    "region_pairs": Plan(R.PAIRS, **sides),
    "region_pair_cost": costs,
    "region_best_candidate_margin": best,
    "region_top3": Plan(R.TOP3, costs=costs),
    "region_mutual_matches": Plan(R.MUTUAL, best=best),
    "unit_matches": matches,
    "candidate_diagnostics": Plan(M.TOP_CANDIDATES, costs=costs, matches=matches),
    "accepted_matches": accepted,
    "split_merge_candidates": Plan(M.SPLIT_OR_MERGED, matches=matches),
    "unmatched_regions": Plan(M.UNMATCHED, matches=matches, **sides),
    "point_in_region_assignment": Plan(R.ASSIGNED, blocks=target, regions=source),
    "region_uncovered": Plan(R.UNCOVERED, source=target, target=source),
    "region_range_query": Plan(R.RANGE_QUERY, regions=source, blocks=target),
    "region_binding_query": Plan(R.BINDING_QUERY, regions=source, blocks=target),
    "layout_authority": authority,
    "candidate_decision": Plan(R.CANDIDATE_DECISION, authority=authority),
    "white_completion": Plan(R.WHITE_COMPLETION, target=target, existing=Plan(A.HALF, regions=source)),
    "review_completion": Plan(R.REVIEW_COMPLETION, target=target, review=source),
    "grid_join_equivalence": Plan(R.GRID_PAIRS, **sides),
    "reading_order_rank": Plan(R.READING_ORDER, regions=source),
    "nearest_anchor": Plan(R.NEAREST_ANCHOR, regions=source),
    "page_furniture": Plan(R.FURNITURE, regions=source),
    "paired_id_matches": Plan(R.PAIRED_IDS, pages=pages, **sides),
    "semantic_route": Plan(U.ROUTES, labels=Plan(U.PART_LABELS, part="part")),
    "qa_issue_rows": issues,
    "qa_page_summary": summary,
    "qa_book_rollup": Plan(U.BOOK_ROLLUP, pages=pages, summary=summary),
    "qa_code_rollup": Plan(U.CODE_CUBE, issues=issues),
    "transfer_record_summary": Plan(U.RECORD_SUMMARY, records=triaged),
    "transfer_reason_histogram": Plan(U.REASONS, records=records),
    "transfer_triage": triaged,
    "transfer_review_rows": Plan(U.REVIEW_ROWS, records=records),
    "completion_needed": Plan(U.COMPLETION_NEEDED, pages=pages, records=records),
    "page_triage": Plan(U.PAGE_TRIAGE, pages=pages, triaged=triaged),
    "registration_gate_reason": Plan(U.REGISTRATION_GATE, pages=pages),
    "registration_rank": Plan(P.REGISTRATION_QUALITY, candidates=Plan(A.CANDIDATES, pages=pages)),
    "source_evidence": sources,
    "source_arbitration": Plan(U.SELECTED_SOURCE, evidence=sources),
    "mode_violations": Plan(U.MODE_VIOLATIONS, orders="orders"),
    "mask_transfer_issues": Plan(D.MASK_ISSUES, **audited),
    "direct_transfer_issues": Plan(D.DIRECT_ISSUES, **audited),
    "guarded_transfer_issues": Plan(D.GUARDED_ISSUES, **audited),
    "clear_mask_issues": Plan(D.CLEAR_ISSUES, clear=Plan(A.CLEAR, orders="orders"), residual=Plan(A.RESIDUAL, regions=target)),
    "semantic_coverage_issues": Plan(D.COVERAGE_ISSUES, items=items, records=transfers),
    "photo_pair_issues": Plan(D.PHOTO_ISSUES, photo_pages=Plan(A.PHOTO_PAGES, orders="orders"), records=transfers),
    "artifact_ownership": Plan(D.OWNERSHIP, files=files),
    "mode_artifact_leaks": leaks,
    "workspace_integrity": integrity,
    "workspace_integrity_failed": Plan(D.INTEGRITY_FAILED, integrity=integrity),
    "layout_labels": Plan(P.LABELS, labelled=Plan(A.LABELLED, part="part")),
    "layout_text_blocks": Plan(P.LAYOUT_BLOCKS, items=items),
    "layout_bubbles": Plan(P.LAYOUT_BUBBLES, items=items),
    "sure_blocks": Plan(P.SURE_BLOCKS, regions=source),
    "authority_filter": Plan(P.KEPT_BY_AUTHORITY, authority=Plan(A.AUTHORITY_ROWS, authority=authority)),
    "layout_safety_gate": Plan(P.SAFETY_GATE, proposals=proposals, **kinded),
    "completion_pairs_by_authority": Plan(P.COMPLETION_PAIRS, proposals=proposals, **kinded),
    "completion_existing": Plan(P.EXISTING, candidates=of_source(A.GROUPED), records=transfers),
    "completion_review_boxes": Plan(P.REVIEW_BOXES, records=transfers),
    "transferable_text": transferable,
    "content_gate": Plan(P.CONTENT_GATE, pages=by_order(A.READ_PAGES), blocks=blocks, transferable=transferable),
    "preserved_layouts": Plan(P.PRESERVED, records=transfers),
    "layout_complete": Plan(P.LAYOUT_COMPLETE, profiles=by_order(A.PROFILES)),
    "direct_invariants": Plan(P.INVARIANTS, plans=direct_plans, missing=direct_plans, records=transfers),
    "mark_rows": marks,
    "resolved_marks": Plan(P.RESOLVED_MARKS, pages=by_order(A.NAMED_PAGES), marks=marks),
    "region_counts": region_counts,
    "probed_marks": Plan(P.PROBED_MARKS, pages=Plan(A.PROBED, pages=pages), counts=region_counts),
    "resume_marks": Plan(P.RESUME_MARKS, cached=by_order(A.CACHED)),
    "transfer_strategies": Plan(P.STRATEGIES, pages=by_order(A.PLANNED)),
    "unit_region_kinds": Plan(P.UNIT_KINDS, units=of_source(A.UNIT_FACTS)),
    "authority_rescue": Plan(P.RESCUED, pairs=Plan(A.RESCUES, matches=paired, pages=pages), source=of_source(A.VERDICTS), target=Plan(A.FAR_VERDICTS, regions=target)),
    "further_detectors": Plan(P.DETECTORS, settings=settings, auxiliaries=by_order(A.ASKED_DETECTORS)),
    "detectors_run": Plan(P.RUN_DETECTORS, settings=settings),
    "review_state": Plan(P.REVIEW_STATE, reviews=by_order(A.REVIEWS)),
    "visual_evidence": Plan(P.VISUAL_EVIDENCE, pages=by_order(A.SEEN_PAGES), records=transfers),
    "mode_effects": Plan(P.MODE_EFFECTS, pages=by_order(A.COUNTERS), records=transfers),
    "resume_ahead": Plan(P.AHEAD, pages=by_order(A.SIZED_PAGES), sixteen=Plan(A.SIXTEEN, region="region")),
    "result_state": Plan(P.RESULTS, results=by_order(A.RESULT_FILES)),
    "page_workspaces": Plan(P.WORKSPACES, pages=by_order(A.OWN_FOLDERS), folders=by_order(A.FOLDERS)),
    "reveal_gate": Plan(P.REVEAL_GATE, pages=Plan(A.ODD_PAGES, pages=pages)),
    "reveal_authority": Plan(P.REVEAL_AUTHORITY, regions=of_source(A.DETECTED)),
    "covered_seeds": Plan(P.COVERED_SEEDS, seeds=source, accepted=target),
    "retagged_regions": Plan(P.RETAGGED, regions=of_source(A.TAGGED)),
    "applied_regions": Plan(P.APPLIED_REGIONS, triaged=triaged),
    "diff_confidence": Plan(P.DIFF_CONFIDENCE, changes=Plan(A.CHANGES, regions=source, pages=pages)),
    "group_labels": Plan(P.GROUP_LABELS, groups=of_source(A.GROUPS)),
    "region_actions": Plan(P.REGION_ACTIONS, actions=of_source(A.ACTIONS)),
    "as_of_states": Plan(B.AS_OF, marks=Plan(A.CLICKS, trace=trace), states=Plan(A.STATES, trace=trace)),
    "edition_regions": Plan(B.EDITIONS, **sides),
    "common_kinds": Plan(B.COMMON_KINDS, **sides),
    "lost_kinds": Plan(B.LOST_KINDS, **sides),
    "kind_cube": Plan(B.KIND_CUBE, regions=source),
    "kind_grouping_sets": Plan(B.KIND_SETS, regions=source),
    "region_ranks": Plan(B.RANKS, regions=source),
    "region_frames": Plan(B.FRAMES, regions=source),
    "confidence_percentiles": Plan(B.PERCENTILES, regions=source),
    "surest_regions": Plan(B.SUREST, regions=source),
    "page_calendar": Plan(B.CALENDAR, orders="orders"),
    "match_chains": Plan(B.CHAINS, matches=paired),
    "odd_pages": Plan(B.ODD_PAGES, pages=pages),
    "mean_confidence": Plan(B.MEAN_CONFIDENCE, regions=source),
    "grid_cells": Plan(B.GRID_CELLS, regions=source),
    "bubble_matches": Plan(N.BUBBLE_MATCHES, assigned=Plan(N.ASSIGNED, costs=Plan(N.BUBBLE_COSTS, **sides))),
    "named_bubbles": named,
    "bubble_binding": Plan(N.BUBBLE_BINDING, named=named, assigned=Plan(N.ASSIGNED, costs=Plan(N.LEFT_COSTS, named=named, **sides))),
    "region_binding": Plan(N.REGION_BINDING, assigned=Plan(N.ASSIGNED, costs=region_costs), costs=region_costs),
    "remaining_pairs": Plan(N.REMAINING, handled=Plan(A.HANDLED, records=transfers), **naming),
    "unlisted_blocks": Plan(N.UNLISTED, pages=pages, blocks=target, listed=Plan(A.LISTED, assigned=assigned_blocks)),
    "cached_bubbles": Plan(N.CACHED_BUBBLES, wanted=by_order(A.WANTED), cached=by_order(A.CACHED_ROWS), items=items),
    "anchor_segments": Plan(N.SEGMENTS, anchors=by_order(A.ANCHORS), sizes=by_order(A.BOOK_SIZES)),
    "frame_expressions": Plan(E.FRAMES, source=of_source(A.IN_BUBBLE), target=Plan(A.IN_BUBBLE, regions=target)),
    "selection_boxes": Plan(E.SELECTIONS, selections=of_source(A.SELECTED)),
    "local_similarity": Plan(E.SIMILARITY, points=of_source(A.POINTS)),
    "boxes_mapped_back": Plan(E.BACK_MAPPED, boxes=of_source(A.WARPED)),
    "text_orientations": Plan(E.ORIENTATIONS, units=of_source(A.DIRECTED), blocks=of_source(A.HINTED)),
    "text_expressions": Plan(E.TEXTS, texts=Plan(A.PHRASES, part="part")),
    "joined_blocks": Plan(E.JOINED_BLOCKS, blocks=turns),
    "file_signatures": Plan(E.FILE_SIGNATURES, files=Plan(A.CONTENTS, documents="documents")),
    "scoped_settings": scoped,
    "job_signatures": signatures,
    "resumable_pages": Plan(E.RESUMABLE, runs=Plan(A.RESUMED, runs=runs), signatures=signatures, finished=Plan(A.FINISHED_JOBS, signatures=signatures, runs=runs)),
    "block_signatures": Plan(E.BLOCK_SIGNATURES, blocks=turns),
    "json_companions": Plan(J.COMPANIONS, files=listing),
    "page_indexes": Plan(J.PAGE_INDEXES, images=by_order(A.IMAGES)),
    "listed_sources": Plan(J.LISTED_SOURCES, listed=by_order(A.MANIFESTS)),
    "second_sources": Plan(J.SECOND_SOURCES, wanted=by_order(A.LOOKED_FOR), files=listing),
    "restored_session": Plan(J.RESTORED, folders=by_order(A.SESSION)),
    "expanded_session": Plan(J.EXPANDED, paired=by_order(A.FOLDER_PAIRS), restored=by_order(A.RESTORED_PAIRS)),
    "trace_sequence": Plan(S.TRACE_SEQUENCE, trace=trace),
    "latest_run_state": Plan(S.LATEST_STATE, trace=trace),
    "history_last50": history,
    "history_counts": Plan(S.HISTORY_COUNTS, history=history),
    "trace_windows_tumbling": Plan(S.TUMBLING, trace=trace),
    "trace_windows_session": Plan(S.SESSIONS, trace=trace),
    "retry_arbitration": Plan(S.RETRY, trace=trace),
    "block_upsert": Plan(S.UPSERTED, trace=trace, deletes=Plan(A.DELETES, trace=trace)),
    "cache_pruning": Plan(S.PRUNED, orders="orders"),
    "output_names": Plan(S.OUTPUT_NAMES, orders="orders"),
    "override_overlay": Plan(S.OVERLAID, source=source, matches=sure, overrides=Plan(A.OVERRIDES, regions=source)),
    "replaced_regions": Plan(S.REPLACED_REGIONS, source=source, matches=matches, costs=costs),
    "text_units": Plan(S.TEXT_UNITS, blocks=turns, bubbles=Plan(A.TURN_BUBBLES, conversations="conversations")),
    "text_unit_ranks": Plan(S.UNIT_RANKS, blocks=turns),
    "stage_fingerprints": prints,
    "resume_pending": Plan(S.PENDING, fingerprints=prints, finished=finished),
    "legacy_props_normalised": Plan(S.LEGACY_PROPS, trace=trace),
    "fingerprint_cost": fingerprint_costs,
    "fingerprint_ratio_matches": Plan(S.RATIO_MATCHES, costs=fingerprint_costs),
    "page_number_keys": numbers,
    "unique_key_pairs": by_number,
    "name_anchor_candidates": Plan(S.NAME_ANCHORS, exact=by_name, numbers=by_number),
    "natural_order_pages": Plan(S.NATURAL_ORDER, numbers=numbers),
    "clean_lines": Plan(S.CLEAN_LINES, documents="documents"),
    "privacy_scan": Plan(S.SECRET_SCAN, texts=Plan(A.TEXTS, documents="documents")),
    "privacy_home_scan": Plan(S.HOME_SCAN, texts=Plan(A.TEXTS, documents="documents")),
    "privacy_path_scan": Plan(S.PATH_SCAN, paths=Plan(A.PATHS, orders="orders")),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: p.query for k, p in PLANS.items()}
ORACLES: dict[str, str] = {k: p.other() for k, p in PLANS.items()}


# Operators over the order or the optimum of a group, which SQL doesn't express; the tests hold them against brute force.


def _ordered_pages(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = (F.col("o_totalprice").cast("long") % 997) / F.lit(997.0)
    rows = docs.select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("page"), F.unix_date(F.col("o_orderdate").cast("date")).alias("ord"), value.alias("value"))
    return rows if not shift else rows.filter(F.col("page") % 7 != 0).withColumn("value", F.col("value") + 0.01)


def page_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.align_pages(_ordered_pages(spark, sf_dir, 0), _ordered_pages(spark, sf_dir, 1))


def greedy_region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.greedy_pairs(source.frame(spark, sf_dir), target.frame(spark, sf_dir))


def greedy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.suppress(source.frame(spark, sf_dir))


def compound_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.split_compounds(source.frame(spark, sf_dir))


def monotone_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Plan(S.NAME_ANCHORS, exact=by_name, numbers=by_number).frame(spark, sf_dir)
    return G.monotone_anchors(pairs.select((F.col("source") % 8).alias("book"), "source", "target", "how"))


def history_undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.replay(H.command_log(spark.read.parquet(f"{sf_dir}/events.parquet")))


def _book_pages(spark: SparkSession, sf_dir: str, edition: int) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    number, price = F.col("o_orderkey") % 400, F.col("o_totalprice").cast("long")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("p"), number)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(("cn", "jp")[edition]), number))
    rows = orders.select(
        F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("page"), F.unix_date(F.col("o_orderdate").cast("date")).alias("ord"), name.alias("name"), F.when(F.col("o_orderkey") % 3 != 2, number.cast("string")).alias("number"),
        F.xxhash64(price % 97).bitwiseXOR(F.lit(edition * 5).cast("long")).alias("hash"), (0.6 + price % 5 / 10).alias("aspect"), ((price % 41) / 41.0).alias("edge"),
    )
    return rows.filter(F.col("page") % 7 != 0) if edition else rows


def book_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.pair_books(_book_pages(spark, sf_dir, 0), _book_pages(spark, sf_dir, 1))


def book_pairs_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.pair_books(_book_pages(spark, sf_dir, 0), _book_pages(spark, sf_dir, 1), by_order=True)


def detector_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.frame(spark, sf_dir).withColumn("phase", (F.col("rid") % 3).cast("long"))
    return N.detector_chain(rows.withColumn("provider", F.concat(F.lit("detector-"), "phase")), 0.62, stop=True)


def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = items.frame(spark, sf_dir).withColumn("state", F.when(F.col("rid") % 5 == 0, "PROTECT").otherwise("UNKNOWN"))
    return N.merged_evidence(Plan(A.ITEMS, regions=source).frame(spark, sf_dir), extra)


def reveal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.reveal_candidates(source.frame(spark, sf_dir), target.frame(spark, sf_dir))


def text_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.text_clusters(of_source(A.GROUPS).frame(spark, sf_dir))


def effect_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.suggestions(target.frame(spark, sf_dir))


def region_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.region_grids(source.frame(spark, sf_dir))


def confidence_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.estimates(source.frame(spark, sf_dir))


def sampled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sampled(source.frame(spark, sf_dir))


def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("stem", T.normal_stem("url"))
    return pages.select("page_id", "stem", T.name_key(F.col("stem")).alias("name_key"), T.number_key(F.col("stem")).alias("number_key"))


def region_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = source.frame(spark, sf_dir).withColumn("polygon", F.expr(geo.box_polygon("")))
    turned = boxes.withColumn("moved", F.expr(geo.transformed("polygon", "array(array(0.8D, -0.6D, 3D), array(0.6D, 0.8D, -2D))")))
    return turned.select("page", F.col("rid").cast("long").alias("rid"), F.expr(f"round({geo.polygon_area('moved')}, 6)").alias("area"), F.expr(f"round({geo.polygon_centroid('moved')}.x, 6)").alias("cx"), F.expr(f"round({geo.polygon_centroid('moved')}.y, 6)").alias("cy"))


_REGION = source.other()
QUERIES |= {
    f.__name__: f
    for f in (page_alignment, greedy_region_pairs, greedy_suppression, compound_split, monotone_anchors, history_undo_redo, book_pairs, book_pairs_by_order, detector_chain, merged_evidence, reveal_candidates, text_clusters, effect_suggestions, region_grids, confidence_estimates, sampled_regions, normalised_names, region_polygons)
}
ORACLES["region_polygons"] = f"""
SELECT page, rid, round((x1 - x0) * (y1 - y0), 6) AS area, round(0.8 * (x0 + x1) / 2 - 0.6 * (y0 + y1) / 2 + 3, 6) AS cx, round(0.6 * (x0 + x1) / 2 + 0.8 * (y0 + y1) / 2 - 2, 6) AS cy FROM ({_REGION}) r"""
