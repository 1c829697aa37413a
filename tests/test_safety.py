"""Guards, archives, and stream forms not covered elsewhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.operators import drift, models
from veristrata.sources import safety
from veristrata.streaming import events as streaming


def test_paths():
    assert safety.safe_join("/data", "a/../b.jpg") == "/data/b.jpg"
    for bad in ("../x", "/etc/passwd", "a/../../x", "a\x00b", "..\\x"):
        with pytest.raises(ValueError):
            safety.safe_join("/data", bad)


def test_json_shape():
    assert safety.json_problem(b'{"a":"[[[[{{{,,,"}', depth=2, items=2) is None
    assert safety.json_problem(b"[" * 5 + b"]" * 5, depth=4) == "too deep"
    assert safety.json_problem(b"[1,2,3]", items=2) == "too many items"
    assert safety.json_problem(b'"\\"["', depth=0) is None


def test_policy(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "uid int, type string")
    got = safety.allowed(rows, spark.createDataFrame([(1, "a"), (1, "b")], "uid int, type string"), ["b"])
    assert {(r["uid"], r["type"]): r["allowed"] for r in got.collect()} == {(1, "a"): True, (1, "b"): False, (2, "a"): False}


def test_archives(spark, tmp_path):
    np.savez(tmp_path / "e.npz", ids=np.array(["x", "y"]), embeddings=np.eye(2))
    v = safety.read_npz(spark, str(tmp_path / "e.npz"))
    assert [(r["sample_id"], list(r["vector"])) for r in v.orderBy("pos").collect()] == [("x", [1.0, 0.0]), ("y", [0.0, 1.0])]
    samples = spark.createDataFrame([(0, "x"), (1, "z")], "pos long, sample_id string")
    assert [r["pos"] for r in safety.order_mismatch(v, samples).collect()] == [1]


def test_query_only_models(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, vector array<double>")
    got = {r["id"]: list(r["scores"]) for r in safety.predict(rows, lambda x: x * 2).collect()}
    assert got[3] == [6.0, 2.0] and len(got) == 5


def test_strip_and_projections(spark):
    clean = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(5)], "input_id int, probs array<double>")
    over = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "input_id int, probs array<double>")
    assert {r["input_id"]: r["low"] for r in models.strip_entropy(over, clean).collect()} == {1: True, 2: False}
    wide = spark.createDataFrame([(1, [1.0] * 20)], "id long, vector array<double>")
    assert drift.projections(wide).count() == 16 and drift.projections(wide, axes=20).count() == 20


def test_nonce_stream(spark, tmp_path, rocks):
    rows = [("l", i, n, t) for i, (n, t) in enumerate([("a", "x"), ("b", "x"), ("a", "anchor_event"), ("a", "x"), ("b", "x"), ("b", "x")])]
    spark.createDataFrame(rows, "ledger_id string, seq long, nonce string, type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.watch_stream(streaming.file_stream(spark, str(tmp_path / "in"), "ledger_id string, seq long, nonce string, type string"))
    # the anchor at 2 repeats a nonce of the interval that it closes, and its own nonce counts in the one that it opens
    assert [r["seq"] for r in streaming.run_available(stream, "nonces", str(tmp_path / "ck")).orderBy("seq").collect()] == [2, 3, 5]


def test_drift_stream(spark, tmp_path):
    spark.range(200).select(F.lit("v").alias("axis"), (F.col("id") / 200 + 0.5).alias("value")).coalesce(1).write.parquet(str(tmp_path / "in"))
    reference = spark.range(200).select(F.lit("v").alias("axis"), (F.col("id") / 200).alias("value"))
    seen = []
    q = streaming.drift_stream(streaming.file_stream(spark, str(tmp_path / "in"), "axis string, value double"), reference, lambda found, n: seen.extend(r["material"] for r in found.collect()))
    q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [True]
