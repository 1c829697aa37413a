"""Streams over files give what the batch forms give."""

from pyspark.sql import functions as F

from tests.conftest import SMALL
from veristrata.operators import governance
from veristrata.streaming import events as streaming


def test_windows(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema.simpleString().removeprefix("struct<").removesuffix(">")
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{SMALL}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in/e"))
    stream = spark.readStream.schema(spark.read.parquet(f"{SMALL}/events.parquet").schema).parquet(str(tmp_path / "in/e"))
    got = streaming.run_available(streaming.tumbling(stream), "tumbling", str(tmp_path / "ck"), "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert schema


def test_watch_in_batches(spark, tmp_path, rocks):
    """A ledger that comes in five batches gives what one walk over it gives, across batches and intervals."""
    rows = []
    for seq in range(60):
        if seq in (17, 18, 41):
            continue
        kind = "anchor_event" if seq % 20 == 19 else "degraded_marker" if seq == 33 else "inference"
        rows.append(("l1", seq, kind, {25: "n21", 30: "n5", 39: "n22", 45: "n39", 58: "n58"}.get(seq, f"n{seq}")))
    rows += [("l2", 0, "inference", "n1"), ("l2", 1, "inference", "n1")]
    for k in range(5):
        part = rows[k * 12 : (k + 1) * 12 if k < 4 else None]
        spark.createDataFrame(part, "ledger_id string, seq long, type string, nonce string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "ledger_id string, seq long, type string, nonce string"
    stream = streaming.watch_stream(streaming.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1))
    got = sorted((tuple(r) for r in streaming.run_available(stream, "watched", str(tmp_path / "ck")).collect()), key=lambda r: r[:3])
    want, seen, last = [], {}, {}
    for ledger, seq, kind, nonce in rows:
        own = seen.setdefault(ledger, {})
        if seq > last.get(ledger, -1) + 1:
            want.append((ledger, seq, "missing", None, seq - last.get(ledger, -1) - 1))
        if kind == "degraded_marker":
            want.append((ledger, seq, "declared_gap", None, None))
        if nonce in own:
            want.append((ledger, seq, "nonce_reuse", nonce, own[nonce]))
        if kind == "anchor_event":
            own.clear()
        own[nonce] = seq
        last[ledger] = seq
    assert len(want) >= 6 and got == sorted(want, key=lambda r: r[:3])


def test_fold_stream_equals_batch(spark, tmp_path, rocks):
    rows = [(i, f"u{i % 3}", governance.ACTIONS[i % 6], f"f{i % 4}", i - 1 if i % 6 == 3 else None, "accept", "u9") for i in range(40)]
    schema = "seq long, actor_id string, action string, finding_id string, refs_seq long, new_disposition string, assignee string"
    for k in range(4):  # in four batches
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.fold_stream(streaming.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1))
    got: dict = {}
    for r in streaming.run_available(stream, "folded", str(tmp_path / "ck"), "update").collect():
        if r["finding_id"] not in got or r["last_seq"] > got[r["finding_id"]][-1]:
            got[r["finding_id"]] = tuple(r)
    found = spark.createDataFrame([(f"f{i}", "review") for i in range(4)], "finding_id string, disposition string")
    want = {r["finding_id"]: tuple(r) for r in governance.fold(found, spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_merkle_stream(spark, tmp_path):
    spark.createDataFrame([("l", i, f"r{i}") for i in range(11)], "ledger_id string, seq long, rec string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.merkle_stream(streaming.file_stream(spark, str(tmp_path / "in"), "ledger_id string, seq long, rec string"))
    row = streaming.run_available(stream, "roots", str(tmp_path / "ck"), "update").first()
    tree = streaming.MerkleAccumulator()
    import hashlib

    for i in range(11):
        tree.append(hashlib.sha256(b"\x00" + f"r{i}".encode()).digest())
    assert (row["size"], row["root"]) == (11, tree.root())
