"""Geometry tests of contributors against every peer, by brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from veristrata.functions import stats
from veristrata.operators import cohorts
from veristrata.operators.running import quantiles

SCHEMA = "sample_id string, contributor string, category string, x double, y double, w double, h double"


def boxes(shift):
    rng, rows = random.Random(8), []
    for name, n in (("a", 70), ("b", 55), ("c", 40), ("d", 9)):
        for i in range(n):
            moved = shift if name == "c" else 0.0
            # coarse places, so that values tie within and between contributors
            rows.append((f"{name}{i}", name, "car", round(rng.uniform(0.1, 0.4) + moved, 2), round(rng.uniform(0.1, 0.5), 2), 0.2, 0.1 + 0.01 * (i % 7)))
    rows += [(f"solo{i}", "a", "bike", 0.1, 0.1, 0.2, 0.2) for i in range(20)]
    return rows + [("flat", "a", "car", 0.1, 0.1, 0.0, 0.2), ("none", None, "car", 0.1, 0.1, 0.1, 0.2)]


def distance(a, b):
    return max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in {*a, *b})


@pytest.mark.parametrize("shift", [0.0, 0.3, -0.3])
def test_geometry_is_brute_force(spark, shift):
    rows = spark.createDataFrame(boxes(shift), SCHEMA)
    features = cohorts.box_features(rows, ["sample_id"])
    held = {}
    for r in features.collect():
        if r["contributor"] is not None:
            held.setdefault((r["category"], r["feature"]), {}).setdefault(r["contributor"], []).append((r["sample_id"], r["value"]))
    groups = {k: {c: [v for _, v in x] for c, x in g.items() if len(x) >= 15} for k, g in held.items()}
    groups = {k: g for k, g in groups.items() if len(g) > 1}
    family, want, hits = sum(len(g) for g in groups.values()), {}, {}
    for k, g in groups.items():
        for c, mine in g.items():
            mid, peers = statistics.median(mine), []
            for o, other in g.items():
                if o != c:
                    om = statistics.median(other)
                    spread = max(1.4826 * statistics.median([abs(v - om) for v in other]), cohorts.SPREAD_FLOORS[k[1]])
                    peers.append(((mid - om) / spread, om, spread, stats.ks_p_value(distance(mine, other), len(mine), len(other))[0]))
            if all(p[0] >= 1 for p in peers) or all(p[0] <= -1 for p in peers):
                near, p = min(peers, key=lambda q: abs(q[0])), min(1.0, max(q[3] for q in peers) * family)
                want[(*k, c)] = (near[0], p, p < 1e-3)
                for sample, v in held[k][c]:
                    z = (1 if near[0] > 0 else -1) * (v - near[1]) / near[2]
                    if p < 1e-3 and z >= 1.5:
                        hits.setdefault(sample, []).append((k[1], z))
    tests = cohorts.geometry_tests(features).cache()
    got = {(r["category"], r["feature"], r["contributor"]): (r["shift"], r["p_adjusted"], r["flagged"]) for r in tests.collect()}
    assert set(got) == set(want) and bool(want) == bool(shift)
    for k, (near, p, flagged) in want.items():
        assert got[k][0] == pytest.approx(near) and got[k][1] == pytest.approx(p, rel=1e-6, abs=1e-300) and got[k][2] == flagged
    found = {r["sample_id"]: (r["features"], r["z"], r["severity"]) for r in cohorts.geometry_hits(features, tests).collect()}
    assert set(found) == set(hits)
    for sample, h in hits.items():
        assert found[sample][0] == sorted({f for f, _ in h}) and found[sample][1] == pytest.approx(max(z for _, z in h))
        assert found[sample][2] == ("medium" if len({f for f, _ in h}) > 1 else "low")


def test_no_boxes(spark):
    features = cohorts.box_features(spark.createDataFrame([], SCHEMA), ["sample_id"])
    tests = cohorts.geometry_tests(features)
    assert tests.count() == 0 and cohorts.geometry_hits(features, tests).count() == 0


def test_boxes_are_read_twice_and_not_shuffled_whole(spark):
    """Once to count values, once to find the hits, whose join leaves the boxes where they are."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame(boxes(0.3), SCHEMA).localCheckpoint()
    features = cohorts.box_features(rows.withColumn("x", watched("x")), ["sample_id"])
    hits = cohorts.geometry_hits(features, cohorts.geometry_tests(features))
    assert hits.count() > 0 and seen.value <= 2 * rows.count()
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_weighted_quantiles(spark):
    values = [("a", 1.0, 3), ("a", 2.0, 2), ("a", 7.5, 5), ("b", 4.0, 1), (None, 2.0, 2), (None, 3.0, 2)]
    rows = spark.createDataFrame(values, "g string, v double, k long")
    got = {r["g"]: r["quantiles"] for r in quantiles(rows, "v", [0.5, 0.9], ["g"], "k").collect()}
    assert got == {"a": [4.75, 7.5], "b": [4.0, 4.0], None: [2.5, 3.0]}
