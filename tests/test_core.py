import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagewright.functions import geometry as geo
from pagewright.functions import text as T
from pagewright.queries import ORACLES, PLANS, QUERIES
from pagewright.sources import documents as D

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


SMALL = ("accepted_matches", "layout_authority", "page_triage", "semantic_route", "trace_windows_session", "reading_order_rank", "resume_pending", "mode_violations", "region_polygons")


@pytest.mark.parametrize("name", SMALL)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = sorted(tuple(show(r[c]) for c in cols) for r in got.collect())
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]}) q")
    assert rows == sorted(tuple(show(v) for v in r) for r in cur.fetchall())
    assert len(PLANS) > 60


def test_boxes(spark):
    rows = [(0, 0, 10, 10, 0, 0, 10, 10), (0, 0, 10, 10, 10, 0, 20, 10), (0, 0, 10, 10, 2, 2, 4, 4), (0, 0, 0, 0, 0, 0, 5, 5), (5, 5, 0, 0, 0, 0, 9, 9), (0, 0, 10, 10, 13, 14, 20, 20)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{p}{c} double" for p in "ab" for c in ("x0", "y0", "x1", "y1")))
    out = df.selectExpr(f"{geo.iou('a', 'b')} i", f"{geo.over_smaller('a', 'b')} o", f"{geo.gap('a', 'b')} g").collect()
    assert [round(r.i, 4) for r in out] == [1, 0, 0.04, 0, 0, 0]
    assert [r.o for r in out] == [1, 0, 1, 0, 0, 0]
    assert out[5].g == 5 and out[1].g == 0
    nan = spark.sql(f"SELECT {geo.clip('double(\"NaN\")', '0.0', '1.0')} a, {geo.clip('7.0', '0.0', '1.0')} b").first()
    assert (nan.a, nan.b) == (0, 1)


def test_polygons(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)],), ([(0.0, 0.0), (2.0, 2.0), (4.0, 4.0)],), ([(1.0, 3.0), (3.0, 5.0)],)], "p array<struct<x:double,y:double>>")
    out = df.selectExpr(f"{geo.polygon_area('p')} a", f"{geo.polygon_centroid('p')} c").collect()
    assert [r.a for r in out] == [8, 0, 0]
    assert [tuple(r.c) for r in out] == [(2, 1), (2, 2), (2, 4)]


def test_names(spark):
    want = {"a/p-006(1) [3].png": "p-006", "006_cn.jpg": "006", "００６.png": "006", "vol1_page_006.png": "vol1_page_006", "Straße.png": "strasse", "raw.png": "", "漫画.png": "漫画"}
    assert {p: T.stem_of(p) for p in want} == want
    df = spark.createDataFrame([(p,) for p in want] + [(None,)], "path string").withColumn("stem", T.normal_stem("path"))
    out = {r.path: (r.k, r.n) for r in df.select("path", T.name_key(F.col("stem")).alias("k"), T.number_key(F.col("stem")).alias("n")).collect()}
    assert out["a/p-006(1) [3].png"] == ("p006", "6") and out["vol1_page_006.png"] == ("vol1page006", "6") and out["漫画.png"] == ("漫画", None) and out[None] == (None, None)
    keys = spark.createDataFrame([("p10",), ("p2",), ("p2b",)], "n string").orderBy(F.expr(T.padded_sql("n"))).collect()
    assert [r.n for r in keys] == ["p2", "p2b", "p10"]


def test_texts(spark):
    df = spark.createDataFrame([(["你好", " ", "世界"], ["a b", "a　b", "c，，d\r\ne"]), (["one", "two"], [None, ""])], "f array<string>, t array<string>")
    out = df.select(T.joined(F.col("f")).alias("j"), T.region_text(F.col("t")).alias("r"), T.region_text(F.col("t"), True).alias("v")).collect()
    assert [r.j for r in out] == ["你好世界", "one two"]
    assert out[0].r == "ab\nc，d\ne" and out[0].v == "abc，de" and out[1].r == ""
    clean = spark.createDataFrame([(" a \r\n\r\n\r\n b\n",), (None,)], "t string").select(T.cleaned(F.col("t")).alias("c")).collect()
    assert [r.c for r in clean] == ["a\n\nb", ""]
    reasons = spark.createDataFrame([(["overlap=0.5", "x=1"],), (["overlap=bad"],), ([],)], "r array<string>").select(T.reason_value(F.col("r"), "overlap").alias("v")).collect()
    assert [r.v for r in reasons] == [0.5, 0, 0]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"blocks": [{"text": "x", "bbox": [0, 0, 4, 2]}, {"text": "no place"}]}))
    (tmp_path / "b.json").write_text("﻿" + json.dumps([{"id": "q", "polygon": [[0, 0], [1, 0], [1, 1]], "confidence": 0.5, "kind": "sfx"}]))
    rows = {r.id: r for r in D.read_sidecars(spark, f"{tmp_path}/*.json").collect()}
    assert set(rows) == {"block-0000", "q"} and rows["block-0000"].confidence == 1.0 and rows["block-0000"].polygon[2] == [4, 2] and rows["q"].kind == "sfx"
    pages = [
        {"page_index": 0, "prunedResult": {"parsing_res_list": [{"block_label": "text", "block_content": "hi", "block_bbox": [1.2, 2, 99, 128]}, {"block_label": "header", "block_content": "h", "block_bbox": [0, 0, 1, 1]}], "layout_det_res": {"boxes": [{"coordinate": [1, 2, 99, 128], "score": 0.7}]}}},
        {"page_index": 1, "markdown": {"text": "script"}},
    ]
    (tmp_path / "ext.jsonl").write_text("\n".join(map(json.dumps, pages)))
    ext = D.read_external(spark, f"{tmp_path}/ext.jsonl")
    assert sorted((r.page_index, r.text, r.confidence) for r in ext.collect()) == [(0, "hi", 0.7), (1, "script", 0.85)]
    assert D.reference_size(ext.filter("page_index = 0")).first() == (100, 130)
    (tmp_path / "img").mkdir()
    for n in ("p10.PNG", "p2.png", "notes.txt"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert [r.name for r in D.list_pages(spark, f"{tmp_path}/img").orderBy("sort_key").collect()] == ["p2.png", "p10.png"]
    objects = spark.createDataFrame([('{"a":"b"}',), ("true",), ("[1]",), (None,)], "j string").select(D.tolerant_object(F.col("j")).alias("m")).collect()
    assert [r.m for r in objects][:2] == [{"a": "b"}, {"used": "true", "legacy_boolean_flag": "true"}] and not objects[3].m
