"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from factloom.sources import files


def test_ocr_words(spark, tmp_path):
    doc = {"_meta": {"v": "1"}, "p1.jpg": [{"text": "a", "bbox": [1, 2, 3, 4], "conf": 0.5}, {"text": "b", "bbox": [5.5, 6, 7, 8], "conf": 0.9}], "p2.jpg": []}
    (tmp_path / "w.json").write_text(json.dumps(doc))
    rows = files.ocr_words(spark, str(tmp_path / "w.json")).orderBy("ocr_index").collect()
    assert [(r.page, r.ocr_index, r.text, r.x0, r.y1, r.conf) for r in rows] == [("p1.jpg", 0, "a", 1.0, 4.0, 0.5), ("p1.jpg", 1, "b", 5.5, 8.0, 0.9)]


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}], "annotations": [{"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}, {"image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 2, "name": "table"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    rows = files.coco(spark, str(tmp_path / "c.json")).orderBy("ann_idx").collect()
    assert [(r.label, r.x0, r.y0, r.x1, r.y1) for r in rows] == [("table", 1, 2, 4, 6), (None, 0, 0, 1, 1)]


def test_csv_keeps_odd_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nthere, you'), (2, None)], "k int, text string")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.csv(spark, str(tmp_path / "out"), "k int, text string").orderBy("k").collect()
    assert [tuple(r) for r in back] == [(1, 'say "hi"\nthere, you'), (2, None)]


def test_run_replaces_its_partition_only(spark, tmp_path):
    path = str(tmp_path / "runs")
    files.write_run(spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int"), path)
    files.write_run(spark.createDataFrame([("b", 3)], "run_id string, x int"), path)
    assert {(r.run_id, r.x) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_upload_manifest_html_images(spark, tmp_path):
    df = spark.createDataFrame([("a.PDF", b"%PDF-1"), ("a.pdf", b"PK"), ("a.exe", b"%PDF-1"), (None, None)], "n string, c binary")
    assert [r.ok for r in df.select(files.upload_ok(F.col("n"), F.col("c")).alias("ok")).collect()] == [True, False, False, False]
    assert tuple(files.manifest(df).first()) == ("1.0", "n,c", 4)
    assert "<td>a.exe</td>" in files.html_table(df.select("n"), "t & t") and "t &amp; t" in files.html_table(df.select("n"), "t & t")
    (tmp_path / "x.jpg").write_bytes(b"12")
    (tmp_path / "y.txt").write_bytes(b"1")
    assert files.images(spark, str(tmp_path)).select("length").collect()[0][0] == 2


def test_broken_json_gives_nulls(spark, tmp_path):
    (tmp_path / "b.json").write_text("{broken")
    assert files.json_document(spark, str(tmp_path / "b.json"), "a int").collect()[0].a is None
