"""Readers and sinks of page projects, sessions, marks, receipts and general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audits import RECEIPT_SCHEMA
from ..plans.relation import Relation
from .documents import bbox_points

_POINTS = "ARRAY<ARRAY<DOUBLE>>"
_BLOCK = f"STRUCT<id: STRING, polygon: {_POINTS}, text: STRING, confidence: DOUBLE, kind: STRING, reading_order: INT, bubble_id: STRING, meta: MAP<STRING, STRING>>"
_UNIT = f"STRUCT<id: STRING, polygon: {_POINTS}, block_ids: ARRAY<STRING>, text: STRING, confidence: DOUBLE, kind: STRING, reading_order: INT, bubble_id: STRING, meta: MAP<STRING, STRING>>"
_BUBBLE = f"STRUCT<id: STRING, polygon: {_POINTS}, confidence: DOUBLE, kind: STRING, block_ids: ARRAY<STRING>, meta: MAP<STRING, STRING>>"
_MATCH = "STRUCT<source_unit_id: STRING, target_unit_id: STRING, confidence: DOUBLE, cost: DOUBLE, relation: STRING, reasons: ARRAY<STRING>>"
_ISSUE = "STRUCT<code: STRING, severity: STRING, message: STRING, unit_id: STRING, value: STRING, threshold: STRING, meta: MAP<STRING, STRING>>"
#: One page project: pair, registration, the rows of both sides, matches, issues, artifacts.
PROJECT = (
    "page_id STRING, pair STRUCT<source_path: STRING, target_path: STRING, source_index: INT, target_index: INT, confidence: DOUBLE, score: DOUBLE, reasons: ARRAY<STRING>>, "
    "registration STRUCT<matrix: ARRAY<ARRAY<DOUBLE>>, method: STRING, confidence: DOUBLE, inlier_ratio: DOUBLE, reprojection_error: DOUBLE, spatial_coverage: DOUBLE, num_matches: INT, source_size: ARRAY<INT>, target_size: ARRAY<INT>>, "
    f"source_blocks ARRAY<{_BLOCK}>, target_blocks ARRAY<{_BLOCK}>, source_bubbles ARRAY<{_BUBBLE}>, target_bubbles ARRAY<{_BUBBLE}>, source_units ARRAY<{_UNIT}>, target_units ARRAY<{_UNIT}>, matches ARRAY<{_MATCH}>, qa ARRAY<{_ISSUE}>, "
    "artifacts MAP<STRING, STRING>, meta MAP<STRING, STRING>"
)


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Files of one JSON document each; ``strict`` fails on one that isn't of the schema, else it becomes a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_projects(spark: SparkSession, path: str, resumed: bool = False, strict: bool = True) -> DataFrame:
    """Page projects of a folder tree, one row each; nothing is loaded before it is asked for.

    A missing list is an empty one, a single object where a list is expected a list of one; ``resumed`` marks them in ``meta``.
    """
    pages = read_json(spark, path, PROJECT, strict)
    lists = [f.name for f in pages.schema if f.dataType.typeName() == "array"]
    kinds = dict(pages.dtypes)
    pages = pages.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in lists})
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    return pages.withColumn("meta", F.map_concat(meta, F.create_map(F.lit("batch_resume_hit"), F.lit("true"))) if resumed else meta)


def project_rows(projects: DataFrame, part: str) -> DataFrame:
    """The rows of one list of projects ("matches", "source_units", ...) with page_id and place."""
    return projects.select("page_id", F.posexplode(part).alias("place", "row")).select("page_id", "place", "row.*")


def read_bubble_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Bubbles of sidecar files: objects with ``bubbles``, or bare lists; those without polygon or box are dropped."""
    schema = f"bubbles ARRAY<STRUCT<id: STRING, polygon: {_POINTS}, bbox: ARRAY<DOUBLE>, confidence: DOUBLE, kind: STRING, paired_target_id: STRING, paired_source_id: STRING>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    whole = F.when(F.trim("value").startswith("["), F.concat(F.lit('{"bubbles":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    rows = raw.withColumn("doc", F.from_json(whole, schema)).select("file", F.posexplode("doc.bubbles").alias("place", "b"))
    points = F.coalesce(F.when(F.size("b.polygon") > 0, F.col("b.polygon")), F.when(F.size("b.bbox") == 4, bbox_points(F.col("b.bbox"))))
    return rows.select(
        "file", F.coalesce("b.id", F.format_string("bubble-%04d", "place")).alias("id"), points.alias("polygon"), F.coalesce("b.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("b.kind", F.lit("speech")).alias("kind"), "b.paired_target_id", "b.paired_source_id"
    ).filter("polygon IS NOT NULL")


def no_blocks(spark: SparkSession) -> DataFrame:
    """The blocks of a page nobody reads."""
    return spark.createDataFrame([], f"path STRING, id STRING, polygon {_POINTS}, text STRING, confidence DOUBLE, kind STRING, reading_order INT")


def given_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that a caller brings (path, ...) for the pages (path) there are."""
    return blocks.join(pages.select("path").distinct(), "path", "left_semi")


#: The JSON file that goes with a Markdown one: of its own name, else of a name that begins alike, the nearest in length first.
COMPANIONS = Relation("""
SELECT md, json FROM (
  SELECT m.path AS md, j.path AS json, row_number() OVER (PARTITION BY m.path ORDER BY CASE WHEN j.stem = m.stem THEN 0 ELSE 1 END, abs(length(j.stem) - length(m.stem)), j.path) AS turn
  FROM (SELECT *, lower(trim(regexp_replace(stem, '\\\\s*\\\\([0-9]+\\\\)$', ''))) AS plain FROM {files} f WHERE ending IN ('md', 'markdown')) m
  JOIN (SELECT *, lower(trim(regexp_replace(stem, '\\\\s*\\\\([0-9]+\\\\)$', ''))) AS plain FROM {files} g WHERE ending = 'json') j ON j.folder = m.folder AND (j.plain = m.plain OR j.plain LIKE concat(m.plain, '%') OR m.plain LIKE concat(j.plain, '%'))
) x WHERE turn = 1""",
"""
SELECT md, json FROM (
  SELECT m.path AS md, j.path AS json, row_number() OVER (PARTITION BY m.path ORDER BY CASE WHEN j.stem = m.stem THEN 0 ELSE 1 END, abs(length(j.stem) - length(m.stem)), j.path) AS turn
  FROM (SELECT *, lower(trim(regexp_replace(stem, '\\s*\\([0-9]+\\)$', ''))) AS plain FROM {files} f WHERE ending IN ('md', 'markdown')) m
  JOIN (SELECT *, lower(trim(regexp_replace(stem, '\\s*\\([0-9]+\\)$', ''))) AS plain FROM {files} g WHERE ending = 'json') j ON j.folder = m.folder AND (starts_with(j.plain, m.plain) OR starts_with(m.plain, j.plain))
) x WHERE turn = 1""")  # fmt: skip
#: The place of a page's image among those of its folder, counted from the document's first page.
PAGE_INDEXES = Relation("SELECT page_id, row_number() OVER (PARTITION BY folder ORDER BY sort_key, page_id) - start_page AS page_index FROM {images} i")
#: Further sources listed for a page: the first two that are there, in order.
LISTED_SOURCES = Relation("SELECT page, path, kind FROM (SELECT page, path, coalesce(kind, 'alternate') AS kind, place, present FROM {listed} l WHERE place < 2) x WHERE present")
#: The second source of a page: the first of the names and endings looked for that is there.
SECOND_SOURCES = Relation("""
SELECT page, path FROM (
  SELECT w.page AS page, f.path AS path, row_number() OVER (PARTITION BY w.page ORDER BY w.place) AS turn FROM {wanted} w JOIN {files} f ON f.path = concat(w.stem, '.', w.ending)
) x WHERE turn = 1""")
#: The pages of an output tree that can be taken up again: both originals are there, by project or page; with warnings.
RESTORED = Relation("""
SELECT page_id, source, target, source_index, target_index, CASE WHEN failed THEN 'last_run_failed' WHEN final IS NULL THEN 'no_final' ELSE '' END AS warning, source IS NULL OR target IS NULL AS skipped FROM (
  SELECT page_id, coalesce(CASE WHEN project_source_there THEN project_source END, CASE WHEN source_original THEN concat(page_id, '/source_original.png') END, CASE WHEN source_authority THEN concat(page_id, '/source_authority_original.png') END) AS source,
    coalesce(CASE WHEN project_target_there THEN project_target END, CASE WHEN target_original THEN concat(page_id, '/target_original.png') END) AS target, coalesce(nullif(source_index, 0), ordinal) AS source_index, coalesce(nullif(target_index, 0), ordinal) AS target_index, failed, final
  FROM (SELECT p.*, row_number() OVER (ORDER BY page_id) - 1 AS ordinal FROM {folders} p) o
) x""".replace("row_number() OVER (ORDER BY page_id) - 1", "row_number() OVER (PARTITION BY session ORDER BY page_id) - 1"))
#: The pairs of a session: all of its folders' where they are no fewer than those restored, else the restored ones.
EXPANDED = Relation("""
SELECT p.session AS session, p.source AS source, p.target AS target, false AS restored FROM {paired} p JOIN (SELECT session, count(*) AS n FROM {paired} GROUP BY session) a ON a.session = p.session LEFT JOIN (SELECT session, count(*) AS m FROM {restored} GROUP BY session) b ON b.session = p.session WHERE a.n >= coalesce(b.m, 0)
UNION ALL
SELECT r.session, r.source, r.target, true FROM {restored} r LEFT JOIN (SELECT session, count(*) AS n FROM {paired} GROUP BY session) a ON a.session = r.session JOIN (SELECT session, count(*) AS m FROM {restored} GROUP BY session) b ON b.session = r.session WHERE coalesce(a.n, 0) < b.m""")


def marks_json(marks: DataFrame) -> DataFrame:
    """Marks (book, key, page_type, ...) as one JSON document for each book."""
    fields = [c for c in marks.columns if c not in ("book", "key")]
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct(*fields).alias("mark")))))
    return marks.groupBy("book").agg(F.to_json(F.struct(F.lit("pagewright.page_marks.v1").alias("schema"), entries.alias("pages"))).alias("json"))


def marks_from_json(documents: DataFrame) -> DataFrame:
    """The marks of documents (book, json): book, key and the mark's fields as strings; what is no object has none."""
    pages = F.from_json("json", "schema string, pages map<string,map<string,string>>")["pages"]
    return documents.select("book", F.explode(F.coalesce(pages, F.create_map().cast("map<string,map<string,string>>"))).alias("key", "mark"))


def write_receipts(runs: DataFrame, artifacts: DataFrame, path: str) -> None:
    """A receipt for each run (page, run_id, mode, strategy): schema, modes, and its artifacts (page, name, bytes) in order."""
    listed = artifacts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("name", "bytes"))).alias("artifacts"))
    runs.withColumn("schema", F.lit(RECEIPT_SCHEMA)).join(listed, "page", "left").write.mode("append").option("ignoreNullFields", "false").json(path)


def write_bundle(path: str, source: DataFrame, target: DataFrame, matches: DataFrame, summary: DataFrame, wanted: tuple[str, ...] = ("ocr", "matches", "summary")) -> list[str]:
    """The evidence of a replaced translation: recognised blocks of both sides, matches, summary, as asked for; returns what was written."""
    parts = {"source_ocr": ("ocr", source), "target_ocr": ("ocr", target), "unit_matches": ("matches", matches), "summary": ("summary", summary)}
    chosen = [name for name, (group, _) in parts.items() if group in wanted]
    for name in chosen:
        parts[name][1].write.mode("overwrite").json(f"{path}/{name}")
    return chosen


def list_fonts(spark: SparkSession, folder: str, limit: int = 300) -> DataFrame:
    """Font files below a folder by name, at most ``limit`` (as in a menu)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).filter(F.lower(name).rlike(r"\.(ttf|ttc|otf)$")).orderBy("name", "path").limit(limit)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder with their size and channels; what can't be decoded is left out."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")


def read_table(spark: SparkSession, kind: str, where: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table of any source Spark reads: csv (with header), orc, parquet, json, jdbc (``where`` is the url) or kafka (the servers)."""
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
    reader = reader.schema(schema) if schema else reader
    if kind == "jdbc":
        return reader.option("url", where).load()
    if kind == "kafka":
        return reader.option("kafka.bootstrap.servers", where).load()
    return reader.load(where)


def write_table(df: DataFrame, kind: str, where: str, mode: str = "overwrite", **options: str) -> None:
    """The sinks of ``read_table``."""
    writer = df.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | options)
    if kind == "jdbc":
        writer.option("url", where).save()
    elif kind == "kafka":
        writer.option("kafka.bootstrap.servers", where).save()
    else:
        writer.save(where)
