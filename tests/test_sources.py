"""Readers and writers on small files."""

import json
import sqlite3
import struct

from pyspark.sql import functions as F

from veristrata.sources import datasets, ledgers


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "contributor_x/a.jpg", "width": 10, "height": 8}, {"id": 2, "file_name": "", "width": 1, "height": 1}], "annotations": [{"id": 5, "image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4], "iscrowd": 0}, {"id": 6, "image_id": 1, "category_id": 99, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 7, "name": "cat"}, {"id": 3, "name": "dog"}]}
    (tmp_path / "annotations.json").write_text(json.dumps(doc))
    assert datasets.detect(spark, str(tmp_path)) == "coco"
    samples, cats = datasets.read_coco(spark, datasets.coco_manifest(spark, str(tmp_path)))
    assert {r["name"]: r["category_id"] for r in cats.collect()} == {"dog": 0, "cat": 1}
    row = datasets.resolve_contributor(samples).collect()
    assert len(row) == 1 and row[0]["contributor"] == "x" and row[0]["tier"] == "directory"
    assert [(r["annotation_id"], r["category_id"], r["w"]) for r in datasets.annotations(samples).collect()] == [("5", 1, 3.0)]


def test_yolo_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([("a", 0, 10.0, 20.0, 30.0, 40.0, 100, 200)], "stem string, class_id int, x double, y double, w double, h double, width int, height int")
    datasets.write_yolo(boxes, str(tmp_path / "out"))
    text = next((tmp_path / "out").rglob("*.txt")).read_text()
    assert text == "0 0.250000 0.200000 0.300000 0.200000\n"
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/a.txt").write_text(text + "bad line\n1 x 0.1 0.1 0.1\n")
    got = datasets.read_yolo(spark, str(tmp_path), boxes.select("stem", "width", "height")).collect()
    assert [tuple(round(v, 4) for v in (r["x"], r["y"], r["w"], r["h"])) for r in got] == [(10.0, 20.0, 30.0, 40.0)]


def test_voc_refuses_doctypes(spark, tmp_path):
    d = tmp_path / "Annotations"
    d.mkdir()
    body = "<annotation><filename>a.jpg</filename><size><width>9</width><height>8</height></size><object><name>cat</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"
    (d / "a.xml").write_text(body)
    (d / "b.xml").write_text("<!DOCTYPE x>" + body)
    rows = datasets.read_voc(spark, str(tmp_path)).collect()
    assert [r["sample_id"] for r in rows] == ["a"]
    assert tuple(rows[0]["objects"][0]["box"]) == (0.0, 1.0, 3.0, 3.0)


def test_folder_sizes(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat/x.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 7, 5) + b"\x08\x02")
    rows = datasets.read_folder(spark, str(tmp_path)).collect()
    assert [(r["category"], r["width"], r["height"]) for r in rows] == [("cat", 7, 5)]
    assert datasets.header_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert datasets.header_size(b"nothing") is None


def test_batches(spark):
    rows = spark.createDataFrame([("source_a/batch_1/x.jpg", None), ("x.jpg", "b\x01"), ("x.jpg", None)], "path string, declared string")
    got = [r["b"] for r in rows.select(datasets.resolve_batch(F.col("path"), F.col("declared")).alias("b")).collect()]
    assert got == ["batch_1", "b_", None]


def test_ledger_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_bytes(b'{"a":1}\n\n{"a":2}')
    rows = ledgers.read_jsonl(spark, str(tmp_path / "l.jsonl")).orderBy("pos").collect()
    assert [r["problem"] for r in rows] == [None, "blank line", "unterminated line"]
    db = sqlite3.connect(tmp_path / "l.db")
    db.execute("create table records(seq, type, nonce, rec_hash, rec)")
    db.execute("insert into records values (0, 'genesis', 'n', x'00', x'7b7d')")
    db.commit()
    db.close()
    assert ledgers.sniff((tmp_path / "l.db").read_bytes()[:16]) == "sqlite"
    assert [(r["seq"], bytes(r["rec"])) for r in ledgers.read_sqlite(spark, str(tmp_path / "l.db")).collect()] == [(0, b"{}")]
    assert ledgers.strict_payload('{"address":"x","b64":"!"}') is None
