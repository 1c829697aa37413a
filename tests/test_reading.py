"""Small operators and corrected semantics against literal tables."""

from pyspark.sql import functions as F

from veristrata.operators import governance, reading, risk


def test_calibrated_levels(spark):
    """Edges are the upper ends of blocks; a score an edge's width above it belongs to the next block, scores above all to the last."""
    steps = spark.createDataFrame([("d", [1.0, 2.0, 4.0], [0.1, 0.5, 0.9])], "detector_id string, edges array<double>, levels array<double>")
    rows = [("d", -5.0, "ran"), ("d", 1.0, "ran"), ("d", 1.0 + 1e-13, "ran"), ("d", 1.0 + 1e-9, "ran"), ("d", 3.0, "ran"), ("d", 99.0, "ran"), ("d", 3.0, "error"), ("other", 3.0, "ran")]
    f = spark.createDataFrame([(*r, 0.33) for r in rows], "detector_id string, score double, availability string, confidence double")
    got = [(r["confidence"], r["calibrated"]) for r in risk.calibrate(f, steps).collect()]
    assert sorted(got) == sorted([(0.1, True), (0.1, True), (0.1, True), (0.5, True), (0.9, True), (0.9, True), (0.33, False), (0.33, False)])


def test_isotonic_edges_are_upper_ends(spark):
    rows = [("d", s, bool(y)) for s, y in [(1.0, 0), (2.0, 1), (3.0, 0), (4.0, 1), (5.0, 1)]]
    got = risk.fit_calibration(spark.createDataFrame(rows, "detector_id string, score double, attacked boolean")).first()
    assert got["edges"] == [1.0, 3.0, 5.0] and got["levels"] == [0.0, 0.5, 1.0]


def test_reason_codes(spark):
    rows = [("copies.text", "known_benign", None), ("copies.text", "test_data", "unknown_reason_code"), ("prov.chain", "test_data", None), ("prov.chain", "known_benign", "unknown_reason_code"), ("prov.chain", "false_positive_confirmed", None)]
    e = spark.createDataFrame([(*r, "override", "0123abcd", "a long enough text", "u") for r in rows], "detector_id string, reason_code string, want string, action string, request_id string, justification string, assignee string")
    got = e.select("*", governance.error_code().alias("error"), governance.audit_flagged().alias("audit")).collect()
    assert all(r["error"] == r["want"] for r in got) and [r["audit"] for r in got] == [False] * 4 + [True]


def test_shares_and_majority_of_ties(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 5), ("b", 3), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(r["g"], r["v"]): (round(r["ecdf"], 6), r["mean_rank"]) for r in reading.shares(df, "g", "v").collect()}
    assert got == {("a", 1): (0.666667, 1.5), ("a", 2): (1.0, 3.0), ("b", 3): (0.5, 1.0), ("b", 5): (1.0, 2.0)}
    best = {r["g"]: (r["value"], r["n"], r["strict"]) for r in reading.majority(df.where("v is not null"), "g", "v").collect()}
    assert best == {"a": (1, 2, True), "b": (3, 1, False)}


def test_sets_and_states(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "v string") for s in ("xyx", "yz"))
    assert {(r["v"], r["stands"]) for r in reading.compared(a, b, "v").collect()} == {("x", "left"), ("y", "both"), ("z", "right")}
    assert [r["v"] for r in reading.unknown_ids(a, b, "v").collect()] == ["z"]
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "q")], "seq int, payload_sha256 string")
    assert {r["seq"]: r["state"] for r in reading.payload_state(left, spark.createDataFrame([("a",), ("a",)], "sha256 string")).collect()} == {1: "held", 2: "none", 3: "missing"}
    sample = reading.seeded_sample(spark.range(100).withColumn("f", F.col("id") == 77), "id", "s", 10, F.col("f")).collect()
    assert len(sample) == 10 and sample[0]["id"] == 77
