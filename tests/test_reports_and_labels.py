"""Report files, caches, calibration files, label errors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veristrata.operators import labels
from veristrata.plans import capability
from veristrata.sources import reports


def test_report_round_trip(spark, tmp_path):
    name = reports.scan_id("20240101", 7)
    found = capability.status_finding(spark, name, {"detector_id": "d", "availability": "error", "reason": "x"})
    full = spark.createDataFrame([], capability.FINDING).unionByName(found, allowMissingColumns=True)
    reports.reserve(spark, f"{tmp_path}/{name}")
    with pytest.raises(FileExistsError):
        reports.reserve(spark, f"{tmp_path}/{name}")
    doc = reports.report(name, full, [{"detector_id": "d", "decision": "run", "reason": ""}], "REVIEW", ["a", "a"])
    reports.write_report(spark, f"{tmp_path}/{name}", doc)
    found = reports.discover(spark, str(tmp_path)).cache()
    assert [(r["scan_id"], r["problem"]) for r in found.collect()] == [(name, None)]
    assert [(r["detector_id"], r["availability"]) for r in reports.findings_of(found).collect()] == [("d", "error")]
    assert json.loads(reports.read_text(spark, f"{tmp_path}/{name}/report.json"))["limitations"] == ["a"]


def test_evidence_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(b"a", "k"), (b"a", "k"), (b"b", "k")], "content binary, kind string")
    for _ in range(2):
        reports.write_evidence(rows, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 2


def test_cache(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", 1), ("b", None)], "key string, value int")
    every, fresh = reports.through_cache(keys, cache, lambda k: k.withColumn("value", F.lit(9)))
    assert {r["key"]: r["value"] for r in every.collect()} == {"a": 1, "b": 9, "c": 9} and fresh.count() == 2


def test_calibration_files():
    rows = [("d", [0.0, 1.0], [0.1, 0.9])]
    assert reports.read_calibration(reports.write_calibration(rows)) == rows
    for bad in ('{"detectors":{"d":{"edges":[1,0],"levels":[0,1]}}}', '{"detectors":{"d":{"edges":[0],"levels":[2]}}}', '{"detectors":{},"detectors":{}}'):
        with pytest.raises(ValueError):
            reports.read_calibration(bad)


def test_confident_errors(spark):
    rng = random.Random(5)
    rows, wrong = [], set()
    for i in range(300):
        c = i % 3
        v = [rng.gauss(3.0 if j == c else 0.0, 0.5) for j in range(3)]
        if i % 25 == 0:
            wrong.add(i)
        rows.append((i, v, (c + 1) % 3 if i in wrong else c))
    probs = labels.out_of_fold(spark.createDataFrame(rows, "id long, vector array<double>, label int"), folds=3)
    assert probs.count() == 300
    found = {r["id"] for r in labels.confident_errors(probs.cache()).collect()}
    assert found <= wrong and len(found) >= 10


def test_spectral_and_matching(spark):
    rng = random.Random(6)
    rows = [(i, 0, [rng.gauss(0, 0.1) + (5.0 if i < 3 else 0.0), rng.gauss(0, 0.1)]) for i in range(60)]
    top = labels.spectral_scores(spark.createDataFrame(rows, "id long, label int, vector array<double>")).orderBy(F.desc("score")).limit(3)
    assert {r["id"] for r in top.collect()} == {0, 1, 2}
    box = "record_id string, cls int, x double, y double, w double, h double"
    a = spark.createDataFrame([("r", 1, 0.0, 0.0, 10.0, 10.0), ("r", 1, 50.0, 0.0, 10.0, 10.0)], box)
    b = spark.createDataFrame([("r", 1, 0.5, 0.0, 10.0, 10.0), ("r", 2, 50.0, 0.0, 10.0, 10.0)], box)
    row = labels.match_detections(a, b).first()
    assert (row["matched"], row["whole"]) == (1, False)
    assert {r["contributor"]: r["heavy"] for r in labels.heavy_contributors(spark.createDataFrame([("a", True)] * 12 + [("b", False)] * 12, "contributor string, flagged boolean")).collect()} == {"a": True, "b": False}
