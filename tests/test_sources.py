import json

from pyspark.sql import functions as F

from pagewright.sources import documents as D
from pagewright.sources import projects as J


def project(i, **more):
    unit = {"id": f"u{i}", "polygon": [[0, 0], [1, 0], [1, 1]], "block_ids": ["b"], "text": "t", "confidence": 0.9, "kind": "speech", "reading_order": 0, "bubble_id": None, "meta": {"k": "v"}}
    registration = {"matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "method": "m", "confidence": 0.9, "inlier_ratio": 0.5, "reprojection_error": 1.0, "spatial_coverage": 0.3, "num_matches": 9, "source_size": [8, 9], "target_size": [8, 9]}
    return {"page_id": f"p{i}", "pair": {"source_path": "s", "target_path": "t", "source_index": i}, "registration": registration, "source_units": [unit], "matches": [{"source_unit_id": f"u{i}", "target_unit_id": "v", "confidence": 0.8, "cost": 0.1, "relation": "one_to_one", "reasons": ["a=1"]}]} | more


def test_projects(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}").mkdir()
        (tmp_path / f"p{i}" / "project.json").write_text(json.dumps(project(i, meta={"mode": "hybrid"} if i else None), indent=2))
    pages = J.read_projects(spark, f"{tmp_path}/*/project.json", resumed=True)
    assert pages.count() == 3 and pages.filter(F.size("target_units") == 0).count() == 3
    assert {r.meta["batch_resume_hit"] for r in pages.collect()} == {"true"}
    assert sorted(r.source_unit_id for r in J.project_rows(pages, "matches").collect()) == ["u0", "u1", "u2"]
    assert J.project_rows(pages, "source_units").first().meta == {"k": "v"}


def test_sidecars_and_blocks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"bubbles": [{"id": "x", "polygon": [[0, 0], [2, 0], [2, 2]]}, {"bbox": [0, 0, 4, 5]}, {"id": "none"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"bbox": [1, 1, 2, 2], "confidence": 0.4, "kind": "narration", "paired_target_id": "q"}]))
    rows = {r.id: r for r in J.read_bubble_sidecars(spark, f"{tmp_path}/*.json").collect() if r.file.endswith("a.json")}
    assert set(rows) == {"x", "bubble-0001"} and len(rows["bubble-0001"].polygon) == 4 and rows["x"].confidence == 1.0 and rows["x"].kind == "speech"
    assert J.no_blocks(spark).count() == 0
    blocks = spark.createDataFrame([("a", "1"), ("z", "2")], "path string, id string")
    assert [r.id for r in J.given_blocks(spark.createDataFrame([("a",), ("a",), ("b",)], "path string"), blocks).collect()] == ["1"]


def test_marks_receipts_and_bundles(spark, tmp_path):
    marks = spark.createDataFrame([("b", "p1", "cover", "manual"), ("b", "p2", "blank", "auto")], "book string, key string, page_type string, origin string")
    document = J.marks_json(marks)
    assert json.loads(document.first().json)["pages"]["p1"] == {"page_type": "cover", "origin": "manual"}
    back = J.marks_from_json(document.unionByName(spark.createDataFrame([("c", "[1]"), ("d", None)], "book string, json string")))
    assert {(r.book, r.key, r.mark["page_type"]) for r in back.collect()} == {("b", "p1", "cover"), ("b", "p2", "blank")}
    runs = spark.createDataFrame([(1, "r1", "hybrid", "")], "page long, run_id string, mode string, strategy string")
    J.write_receipts(runs, spark.createDataFrame([(1, "b.png", 5), (1, "a.png", 4)], "page long, name string, bytes long"), f"{tmp_path}/receipts")
    receipt = spark.read.json(f"{tmp_path}/receipts").first()
    assert receipt.schema == "pagewright.run_receipt.v1" and [a.name for a in receipt.artifacts] == ["a.png", "b.png"]
    assert J.write_bundle(f"{tmp_path}/bundle", marks, marks, marks, marks, ("ocr", "summary")) == ["source_ocr", "target_ocr", "summary"]
    assert spark.read.json(f"{tmp_path}/bundle/summary").count() == 2


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, name string")
    for kind in ("csv", "orc", "parquet", "json"):
        J.write_table(df, kind, f"{tmp_path}/{kind}")
        back = J.read_table(spark, kind, f"{tmp_path}/{kind}", "id long, name string")
        assert sorted((r.id, r.name) for r in back.collect()) == [(1, "a,b"), (2, None)], kind
    D.write_pages(df.withColumn("book", F.lit(7)), f"{tmp_path}/pages")
    assert spark.read.parquet(f"{tmp_path}/pages").filter("book = 7").count() == 2
    (tmp_path / "fonts").mkdir()
    for name in ("a.TTF", "b.otf", "c.txt"):
        (tmp_path / "fonts" / name).write_bytes(b"x")
    assert [r.name for r in J.list_fonts(spark, f"{tmp_path}/fonts").collect()] == ["a.TTF", "b.otf"]
