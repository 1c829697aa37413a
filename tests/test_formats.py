"""Data sources: what is written is read back, damage gives problems, failed saves leave nothing."""

import hashlib
import json
import os
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from veristrata.sources import formats


@pytest.fixture(scope="module")
def sources(spark):
    formats.register(spark)
    return spark


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_jsonl_in_ranges(sources, tmp_path, monkeypatch):
    rows = [(i, f'{{"n":{i},"t":"{"é" * (i % 7)}"}}'.encode()) for i in range(200)]
    df = sources.createDataFrame(rows, "seq long, rec binary").repartitionByRange(3, "seq").sortWithinPartitions("seq")
    df.write.format("sealed_jsonl").mode("append").save(str(tmp_path / "l"))
    made = files(tmp_path / "l")
    assert made[0] == "_SUCCESS" and len(made) == 4
    assert json.loads((tmp_path / "l/_SUCCESS").read_text()) == {"files": 3, "rows": 200}
    got = sources.read.format("sealed_jsonl").load(str(tmp_path / "l")).orderBy("file", "at").collect()
    assert [bytes(r["rec"]) for r in got] == [r for _, r in rows] and all(r["problem"] is None for r in got)
    # every cut of a file into ranges gives each line once
    (tmp_path / "odd.jsonl").write_bytes(b'{"a":1}\n\n \n{"b":2}\n{"c":3}')
    want = [(0, b'{"a":1}', None), (8, b"", "blank line"), (9, b" ", "blank line"), (11, b'{"b":2}', None), (19, b'{"c":3}', "unterminated line")]
    for size in range(1, 28):
        monkeypatch.setattr(formats, "RANGE_BYTES", size)
        reader = formats.JsonlReader(str(tmp_path / "odd.jsonl"))
        assert [row[1:] for p in reader.partitions() for row in reader.read(p)] == want, size


def test_sqlite(sources, tmp_path, monkeypatch):
    rows = [(i, "inference", f"n{i}", hashlib.sha256(bytes([i])).digest(), b'{"n":%d}' % i) for i in range(50)]
    df = sources.createDataFrame(rows, "seq long, type string, nonce string, rec_hash binary, rec binary").repartitionByRange(2, "seq").sortWithinPartitions("seq")
    df.write.format("sealed_sqlite").mode("append").save(str(tmp_path / "l"))
    got = sources.read.format("sealed_sqlite").load(str(tmp_path / "l")).orderBy("file", "at").collect()
    assert [(r["seq"], r["type"], r["nonce"], bytes(r["rec_hash"]), bytes(r["rec"])) for r in got] == rows
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("create table records(seq, type, nonce, rec_hash, rec)")
    db.executemany("insert into records values (?, 't', 'n', null, ?)", [(i, f"r{i}") for i in range(7)])
    db.commit()
    db.close()
    monkeypatch.setattr(formats, "RANGE_ROWS", 3)
    reader = formats.SqliteReader(str(tmp_path / "x.db"))
    assert len(reader.partitions()) == 3
    assert [row[2] for p in reader.partitions() for row in reader.read(p)] == [f"r{i}".encode() for i in range(7)]


def test_payloads(sources, tmp_path):
    data = [(hashlib.sha256(x).hexdigest(), x) for x in (b"", b"one", b"\x00\xff" * 100)]
    sources.createDataFrame(data, "address string, data binary").coalesce(1).write.format("sealed_payloads").mode("append").save(str(tmp_path / "p"))
    with open(next((tmp_path / "p").glob("*.jsonl")), "a") as f:
        f.write('{"address":"00","b64":"eA=="}\n{"b64":1}\n')
    got = sources.read.format("sealed_payloads").load(str(tmp_path / "p")).collect()
    assert sorted((r["address"], bytes(r["data"])) for r in got if r["problem"] is None) == sorted(data) and sum(r["problem"] is not None for r in got) == 2


def test_coco(sources, tmp_path, monkeypatch):
    rows = [("image", str(i), None, None, f"ü{i}.jpg", 10, 20, "s", None, None, None) for i in range(30)]
    rows += [("annotation", str(i), str(i % 30), "7", None, None, None, None, None, [1.5, 2.0, i + 0.25, 4.0], i % 2 == 0) for i in range(90)] + [("category", "7", None, None, "cat", None, None, None, None, None, None)]
    columns = formats.Coco.columns.replace(", problem string", "")
    sources.createDataFrame(rows, columns).repartition(4).write.format("coco").mode("append").save(str(tmp_path / "c"))
    doc = json.loads((tmp_path / "c/instances.json").read_text())
    assert sorted(len(doc[k]) for k in doc) == [1, 30, 90]
    got = sources.read.format("coco").load(str(tmp_path / "c")).collect()
    key = lambda r: (r["kind"], r["id"], r["image_id"], r["category_id"], r["name"], r["width"], r["height"], r["source"], r["batch"], r["bbox"], bool(r["iscrowd"]))
    assert sorted(map(str, map(key, got))) == sorted(str((*r[:10], bool(r[10]))) for r in rows)
    # the reader takes its blocks anywhere, also inside letters and numbers
    text = json.dumps({"info": {"images": [1, {"id": 0}]}, "images": [{"id": 12345, "file_name": "é"}, {"id": 6}], "more": 1.25, "categories": []}, ensure_ascii=False)
    (tmp_path / "annotations.json").write_text(text)
    real = formats.opened(str(tmp_path))[0]

    class Drip:
        def __init__(self, f, n):
            self.f, self.n = f, n

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, _):
            return self.f.read(self.n)

    for n in (1, 2, 3, 7, 1000):
        reader = formats.CocoReader(str(tmp_path))

        class Store:
            def open_input_stream(self, path, n=n):
                return Drip(real.open_input_stream(path), n)

        reader.store = Store()
        assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["12345", "6"], n
    (tmp_path / "annotations.json").write_text(text[:80])
    reader = formats.CocoReader(str(tmp_path))
    assert [r[-1] is None for p in reader.partitions() for r in reader.read(p)].count(False) >= 1


def test_yolo_and_voc(sources, tmp_path):
    boxes = [(f"i{i % 5}", i % 3, 0.125 * (i % 8), 0.5, 0.25, 0.0625) for i in range(20)]
    df = sources.createDataFrame(boxes, "stem string, class_id long, xc double, yc double, w double, h double")
    df.repartition(2, "stem").sortWithinPartitions("stem", "xc").write.format("yolo").mode("append").save(str(tmp_path / "y"))
    (tmp_path / "y/labels/bad.txt").write_text("1 2\n\n0 a b c d\n9999999 0 0 1 1\n")
    got = sources.read.format("yolo").load(str(tmp_path / "y")).collect()
    assert sorted(tuple(r)[:1] + tuple(r)[2:7] for r in got if r["stem"] != "bad") == sorted(boxes)
    assert sorted((r["line"], r["class_id"], r["problem"] is None) for r in got if r["stem"] == "bad") == [(1, None, False), (3, None, False), (4, 9999999, True)]
    samples = [("a", "a.jpg", 9, 8, [("cat", 0.0, 1.0, 3.0, 3.5)]), ("b", None, None, None, [])]
    shape = "sample_id string, name string, width int, height int, objects array<struct<name:string,x:double,y:double,w:double,h:double>>"
    sources.createDataFrame(samples, shape).write.format("voc").mode("append").save(str(tmp_path / "v"))
    where = tmp_path / "v/Annotations"
    (where / "c.xml").write_text("<!DOCTYPE x><annotation/>")
    (where / "d.xml").write_text("<annotation>" + " " * formats.MOST_BYTES + "</annotation>")
    (where / "e.xml").write_text("<annotation>")
    got = {r["sample_id"]: r for r in sources.read.format("voc").load(str(tmp_path / "v")).collect()}
    assert [(r["name"], r["width"], [tuple(o) for o in r["objects"]]) for k, r in sorted(got.items()) if k in "ab"] == [("a.jpg", 9, [("cat", 0.0, 1.0, 3.0, 3.5)]), (None, None, [])]
    assert set(got) == set("abcde") and all(got[k]["problem"] for k in "cde")


def test_folder(sources, tmp_path):
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", w, h) + b"\x08\x02"
    rows = [("cat", "x.png", png(7, 5)), ("dog", "y.PNG", png(1, 1) + b"z" * 200_000), ("dog", "z.jpg", b"nothing")]
    sources.createDataFrame(rows, "category string, name string, content binary").write.format("image_folder").mode("append").save(str(tmp_path / "f"))
    got = sorted((r["category"], r["sample_id"], r["width"], r["height"], r["content_sha256"], r["problem"] is None) for r in sources.read.format("image_folder").load(str(tmp_path / "f")).collect())
    assert got == sorted((c, n.split(".")[0], *((7, 5) if n == "x.png" else (1, 1) if n == "y.PNG" else (None, None)), hashlib.sha256(d).hexdigest(), n != "z.jpg") for c, n, d in rows)


def test_saves_are_whole_or_nothing(sources, tmp_path):
    at = str(tmp_path / "l")
    good = sources.createDataFrame([(0, b"{}"), (1, b"{}")], "seq long, rec binary").repartition(2, "seq")
    bad = good.withColumn("rec", F.when(F.col("seq") == 1, F.lit("a\nb").cast("binary")).otherwise(F.col("rec")))
    with pytest.raises(Exception, match="line end"):
        bad.write.format("sealed_jsonl").mode("append").save(at)
    assert files(at) == []
    good.write.format("sealed_jsonl").mode("append").save(at)
    before = files(at)
    with pytest.raises(Exception, match="FileExists"):
        good.write.format("sealed_jsonl").mode("append").save(at)
    with pytest.raises(Exception, match="line end"):
        bad.write.format("sealed_jsonl").mode("overwrite").save(at)
    assert files(at) == before
    good.where("seq = 1").write.format("sealed_jsonl").mode("overwrite").save(at)
    assert [r["at"] for r in sources.read.format("sealed_jsonl").load(at).collect()] == [0]
    split = sources.createDataFrame([("a", 0, 0.5, 0.5, 0.5, 0.5), ("a", 1, 0.5, 0.5, 0.5, 0.5)], "stem string, class_id long, xc double, yc double, w double, h double").repartition(2, "class_id")
    if split.select(F.spark_partition_id()).distinct().count() > 1:
        with pytest.raises(Exception, match="one partition"):
            split.write.format("yolo").mode("append").save(str(tmp_path / "y"))
        assert files(tmp_path / "y") == []


def test_manifests_are_read_in_sections_of_the_same_file(sources, tmp_path, monkeypatch):
    """One array is many tasks; a manifest that was put in another's place is read by its own structure."""
    rows = [("annotation", str(i), str(i % 30), "7", None, None, None, None, None, [1.5, 2.0, i + 0.25, 4.0], i % 2 == 0) for i in range(90)] + [("category", "7", None, None, "a,]}", None, None, None, None, None, None)]
    sources.createDataFrame(rows, formats.Coco.columns.replace(", problem string", "")).coalesce(1).write.format("coco").mode("append").save(str(tmp_path / "c"))
    monkeypatch.setattr(formats, "RANGE_BYTES", 500)
    writer = formats.CocoWriter(str(tmp_path / "s"), False)
    columns = [c.split()[0] for c in formats.Coco.columns.split(", ")][:-1]
    writer.commit([writer.write(iter(dict(zip(columns, r, strict=True)) for r in part)) for part in (rows[:50], rows[50:])])
    reader = formats.CocoReader(str(tmp_path / "s"))
    pieces = reader.partitions()
    assert len(pieces) > 10
    got = sorted((r for p in pieces for r in reader.read(p)), key=str)
    assert [r[1] for r in got] == [r[1] for r in sorted(rows, key=str)] and all(r[-1] is None for r in got)
    assert {r[0] for p in formats.CocoReader(str(tmp_path / "s"), "category").partitions() for r in reader.read(p)} == {"category"}
    (tmp_path / "s/instances.json").write_text(json.dumps({"annotations": [{"id": 5}]}, indent=1))
    reader = formats.CocoReader(str(tmp_path / "s"))
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["5"]


def test_writers_hold_no_task(tmp_path, monkeypatch):
    """Payloads are sorted and written in bounded pieces, and what a task tells the driver doesn't grow with its files."""
    import pickle

    monkeypatch.setattr(formats, "SORTED_BYTES", 1000)
    writer = formats.PayloadWriter(str(tmp_path / "p"), False)
    data = [(hashlib.sha256(bytes([i]) * 100).hexdigest(), bytes([i]) * 100) for i in range(100)]
    writer.commit([writer.write(iter({"address": a, "data": d} for a, d in [*data, data[0]]))])
    made = list((tmp_path / "p").glob("*.jsonl"))
    assert len(made) > 10 and max(p.stat().st_size for p in made) < 4000
    reader = formats.PayloadReader(str(tmp_path / "p"))
    assert sorted(r[:2] for p in reader.partitions() for r in reader.read(p)) == sorted([*data, data[0]])
    voc = formats.VocWriter(str(tmp_path / "v"), False)
    told = [voc.write(iter({"sample_id": f"{k}-{i}", "name": None, "width": 1, "height": 1, "objects": []} for i in range(n))) for k, n in enumerate((3, 300))]
    assert abs(len(pickle.dumps(told[1])) - len(pickle.dumps(told[0]))) < 10
    voc.commit(told)
    assert len(files(tmp_path / "v")) == 304


def test_planning_holds_a_few_bytes_a_file(tmp_path, monkeypatch):
    """A folder of many small files is read in groups whose names are packed; each file is in one of them."""
    import pickle

    where = tmp_path / "v/Annotations"
    (where / "more/_hidden").mkdir(parents=True)
    names = [f"{i}.xml" for i in range(1200)] + ["é ü.XML", "more/1.xml"]
    for n in [*names, ".x.xml", "_y.xml", "more/_hidden/z.xml", "other.txt"]:
        (where / n).write_text("<annotation/>")
    pieces = formats.VocReader(str(tmp_path / "v")).partitions()
    assert [len(p.files) for p in pieces] == [500, 500, 202]
    assert sorted(f for p in pieces for f in p.files) == sorted(f"{where}/{n}" for n in names)
    assert len(pickle.dumps(pieces)) < 8 * len(names)
    monkeypatch.setattr(formats, "GROUP_FILES", 7)
    reader = formats.VocReader(f"file://{tmp_path}/v")
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == sorted([*map(str, range(1200)), "é ü", "1"])
