"""Sources and sinks: page listings, sidecar and external recognition documents, tolerant JSON, page results.

All readers are Spark's own, with explicit schemas; a file is never opened on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cleaned, padded_sql

#: File endings of page images (fixed values).
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")

_POINTS = "ARRAY<ARRAY<DOUBLE>>"
_BLOCK = f"id STRING, polygon {_POINTS}, bbox ARRAY<DOUBLE>, text STRING, confidence DOUBLE, kind STRING, reading_order INT, bubble_id STRING, meta MAP<STRING, STRING>"
SIDECAR = f"blocks ARRAY<STRUCT<{_BLOCK}>>"
_ROW = "block_label STRING, label STRING, type STRING, block_content STRING, text STRING, content STRING, block_polygon_points {p}, polygon_points {p}, polygon {p}, block_bbox ARRAY<DOUBLE>, bbox ARRAY<DOUBLE>, coordinate ARRAY<DOUBLE>, block_order INT, block_id STRING, group_id STRING".format(p=_POINTS)
EXTERNAL = f"page_index INT, prunedResult STRUCT<parsing_res_list: ARRAY<STRUCT<{_ROW}>>, layout_det_res: STRUCT<boxes: ARRAY<STRUCT<coordinate: ARRAY<DOUBLE>, score: DOUBLE>>>>, parsing_res_list ARRAY<STRUCT<{_ROW}>>, markdown STRUCT<text: STRING>"


def list_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page images of a folder (path, length, modified, sort_key), not of folders below it; order by sort_key for page order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ending = F.regexp_extract(name, r"(\.[a-z0-9]+)$", 1)
    return files.withColumn("name", name).filter(ending.isin(*IMAGE_ENDINGS)).withColumn("sort_key", F.expr(padded_sql("name")))


def bbox_points(box: Column) -> Column:
    """A box [x0, y0, x1, y1] as four points."""
    at = lambda i: F.get(box, F.lit(i))
    return F.array(F.array(at(0), at(1)), F.array(at(2), at(1)), F.array(at(2), at(3)), F.array(at(0), at(3)))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Text blocks of sidecar files: objects with ``blocks``, or bare lists of blocks.

    Blocks with neither polygon nor box are dropped; a missing id, confidence, kind or order becomes the block's number, 1.0,
    "unknown" and its place.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    whole = F.when(F.trim("value").startswith("["), F.concat(F.lit('{"blocks":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    rows = raw.withColumn("doc", F.from_json(whole, SIDECAR)).select("file", F.posexplode("doc.blocks").alias("place", "b"))
    points = F.coalesce(F.when(F.size("b.polygon") > 0, F.col("b.polygon")), F.when(F.size("b.bbox") == 4, bbox_points(F.col("b.bbox"))))
    return rows.select(
        "file",
        F.coalesce("b.id", F.format_string("block-%04d", "place")).alias("id"),
        points.alias("polygon"),
        F.coalesce("b.text", F.lit("")).alias("text"),
        F.coalesce("b.confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("b.kind", F.lit("unknown")).alias("kind"),
        F.coalesce("b.reading_order", "place").alias("reading_order"),
        F.col("b.bubble_id").alias("bubble_id"),
        "b.meta",
    ).filter("polygon IS NOT NULL")


def read_external(spark: SparkSession, path: str, ignored: tuple[str, ...] = ("number", "header", "footer")) -> DataFrame:
    """Blocks of external recognition documents, one JSON object for each page and line.

    Rows are looked for at both depths; blocks of ignored labels and blank ones are dropped; the score is that of the layout box with the same
    rounded coordinates (the last of several), else 0.95.  A page with markdown only gives one transcript block.
    """
    pages = spark.read.schema(EXTERNAL).option("mode", "PERMISSIVE").json(path)
    pages = pages.withColumn("rows", F.coalesce("prunedResult.parsing_res_list", "parsing_res_list"))
    rounded = lambda c: F.array_join(F.transform(c, lambda v: F.rint(v).cast("int").cast("string")), ",")
    scores = F.coalesce(F.transform("prunedResult.layout_det_res.boxes", lambda b: F.struct(rounded(b["coordinate"]).alias("key"), b["score"].alias("score"))), F.array().cast("array<struct<key:string,score:double>>"))
    blocks = pages.withColumn("scores", scores).select("page_index", "scores", F.posexplode("rows").alias("place", "b"))
    box = F.coalesce("b.block_bbox", "b.bbox", "b.coordinate")
    label = F.lower(F.coalesce("b.block_label", "b.label", "b.type", F.lit("unknown")))
    hits = F.filter("scores", lambda s: s["key"] == rounded(box))
    found = blocks.select(
        "page_index",
        F.coalesce("b.block_id", F.format_string("ext-%04d", "place")).alias("id"),
        label.alias("label"),
        cleaned(F.coalesce("b.block_content", "b.text", "b.content")).alias("text"),
        F.coalesce("b.block_polygon_points", "b.polygon_points", "b.polygon", F.when(box.isNotNull(), bbox_points(box))).alias("polygon"),
        F.coalesce("b.block_order", "place").alias("reading_order"),
        F.coalesce(F.get(F.transform(F.reverse(hits), lambda s: s["score"]), F.lit(0)), F.lit(0.95)).alias("confidence"),
    ).filter(~F.col("label").isin(*ignored) & (F.col("text") != ""))
    script = pages.filter(F.col("rows").isNull() & F.col("markdown.text").isNotNull()).select(
        "page_index", F.lit("transcript").alias("id"), F.lit("transcript").alias("label"), cleaned(F.col("markdown.text")).alias("text"),
        F.lit(None).cast(_POINTS).alias("polygon"), F.lit(0).alias("reading_order"), F.lit(0.85).alias("confidence"),
    )
    return found.unionByName(script)


def reference_size(blocks: DataFrame) -> DataFrame:
    """The canvas of a document from its points: the largest x and y to the nearest ten, or null under 64."""
    points = blocks.select(F.explode("polygon").alias("p"))
    top = points.agg(F.max(F.get("p", F.lit(0))).alias("x"), F.max(F.get("p", F.lit(1))).alias("y"))
    near = lambda c: F.rint(F.col(c) / 10) * 10
    return top.select(*(F.when((F.col("x") >= 64) & (F.col("y") >= 64), near(c)).alias(n) for c, n in (("x", "width"), ("y", "height"))))


def tolerant_object(column: Column) -> Column:
    """JSON text as a map of strings: a bool becomes {used, legacy_boolean_flag}, what is no object an empty map."""
    flag = F.trim(column)
    legacy = F.create_map(F.lit("used"), flag, F.lit("legacy_boolean_flag"), F.lit("true"))
    empty = F.create_map().cast("map<string,string>")
    return F.when(flag.isin("true", "false"), legacy).otherwise(F.coalesce(F.from_json(column, "map<string,string>"), empty))


def merged(existing: Column, updates: Column, mutable: tuple[str, ...]) -> Column:
    """Overrides with the mutable keys of an update put over them."""
    allowed = F.map_filter(updates, lambda k, v: k.isin(*mutable))
    return F.map_from_entries(F.concat(F.filter(F.map_entries(existing), lambda e: ~F.array_contains(F.map_keys(allowed), e["key"])), F.map_entries(allowed)))


def write_pages(df: DataFrame, path: str, by: str = "book") -> None:
    """Page rows as Parquet, one folder for each book, replaced as a whole by the commit protocol."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object for each row, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
