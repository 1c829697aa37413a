"""Operators against brute force and planted cases."""

import random

from pyspark.sql import functions as F

from veristrata.operators import drift, risk, similarity
from veristrata.operators.graph import connected_components
from veristrata.plans import queries
from veristrata.plans.capability import Check, Registry, build_plan, execute


def test_hamming_join_is_exact(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(60) for _ in range(40)]
    hashes = sorted({h ^ sum(1 << b for b in rng.sample(range(60), rng.randrange(5))) for h in base for _ in range(5)})
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    for cut, agree in ((3, 1), (3, 3), (6, 2)):
        got = {(r["id_a"], r["id_b"]) for r in similarity.hamming_pairs(rows, cut, agree).collect()}
        want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= cut}
        assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(700, 760)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_drift_finds_the_shifted_axis(spark):
    rows = spark.range(4000).select(F.explode(F.array(F.lit("still"), F.lit("moved"))).alias("axis"), (F.col("id") % 2).cast("int").alias("batch"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("value"))
    rows = rows.withColumn("value", F.col("value") + F.when((F.col("axis") == "moved") & (F.col("batch") == 1), 0.4).otherwise(0.0))
    got = {r["axis"]: r["material"] for r in drift.assess(rows).collect()}
    assert got == {"still": False, "moved": True}


def test_ranking_of_groups(spark):
    """Counts of the mixed-contributor fixture: the guilty one ranks first and alone is quarantined."""
    counts = [("guilty", 30, 30), ("tiny", 5, 3), ("big", 150, 12), ("clean_a", 30, 0), ("clean_b", 30, 0)]
    rows = risk.rank_groups(spark.createDataFrame([("contributor", *c) for c in counts], "kind string, group string, n long, k long")).collect()
    by = {r["group"]: r for r in rows}
    assert by["guilty"]["rank"] == 1 and by["guilty"]["disposition"] == "quarantine"
    assert by["tiny"]["disposition"] != "quarantine"
    assert by["clean_a"]["disposition"] == by["clean_b"]["disposition"] == "accept"


def test_uncalibrated_findings_stop_at_review(spark):
    f = spark.createDataFrame([("copies_near", "copies.text", "high", 0.99, c) for c in (True, False)], "attack_class string, detector_id string, severity string, confidence double, calibrated boolean")
    assert {(r["calibrated"], r["disposition"]) for r in risk.route(f).collect()} == {(True, "quarantine"), (False, "review")}


def test_a_failing_check_becomes_a_finding(spark, tmp_path):
    registry = Registry({"copies_near": "data"})

    def broken(context):
        return spark.range(1).select(F.raise_error(F.lit("no")).alias("finding_id"))

    registry.add(Check("copies.text", "1", frozenset({"labels"}), frozenset(), ("copies_near",), broken))
    registry.add(Check("copies.image", "1", frozenset({"images"}), frozenset(), ("copies_near",), broken))
    plan = build_plan(registry, {"labels"})
    assert [p["decision"] for p in plan] == ["excluded", "run"]
    got = {r["detector_id"]: r["availability"] for r in execute(spark, registry, plan, {"scan_id": "s"}, str(tmp_path)).collect()}
    assert got == {"copies.image": "unavailable", "copies.text": "error"}


def test_contributor_ranking_counts_copies_without_a_near_class(spark, tmp_path):
    """Exact copies are a cluster, and clusters are sized by documents."""
    words = ["alpha", "bravo", "thunder", "kilo", "zulu", "quartz", "ocean", "jigsaw"]
    rows = [(i, "copied chorus of the same text", "copier", "en") for i in range(12)]
    rows += [(100 + i, f"{words[i]} " * 5 + words[(3 * i + 1) % 8] * (i + 1), "other", "en") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["group"]: r for r in queries.contributor_ranking(spark, str(tmp_path)).collect()}
    assert (got["copier"]["n"], got["copier"]["k"]) == (12, 12) and got["other"]["k"] < 8
    hashes = docs.select(F.col("doc_id").alias("id"), similarity.profile_hash(F.col("text")).alias("hash"))
    sized = similarity.sized_classes(hashes, spark.createDataFrame([(0, 0), (100, 0)], "id long, cluster_id long")).where("cluster_id = 0").collect()
    assert {(r["cluster_n"], r["severity"]) for r in sized} == {(13, "high")} and len(sized) == 2
