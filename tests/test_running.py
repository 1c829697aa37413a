"""Running values over ranges, exact quantiles and resampling from counts, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.operators import drift, evaluation, resampling
from veristrata.operators.running import quantiles, running, value_ranks


@pytest.fixture
def many_ranges(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot(n, seed):
    """A third of all rows in one group."""
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(-5, 20)])) for i in range(n)]


@pytest.mark.parametrize("backward", [False, True])
def test_running_values(spark, many_ranges, backward):
    rows = hot(300, 1)
    df = spark.createDataFrame(rows, "i long, g string, v int").repartition(6)
    got = {r["i"]: (r["total"], r["least"], r["most"]) for r in running(df, ["i"], {"total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v"))}, ["g"], backward).collect()}
    for i, g, _ in rows:
        upto = [v for j, h, v in rows if h == g and v is not None and (j >= i if backward else j <= i)]
        assert got[i] == ((sum(upto), min(upto), max(upto)) if upto else (None, None, None))
    none = running(df.limit(0), ["i"], {"t": ("sum", F.col("v"))})
    assert none.count() == 0 and none.columns == ["i", "g", "v", "t"]


def test_ranks_and_quantiles(spark, many_ranges):
    rows = hot(400, 2)
    df = spark.createDataFrame(rows, "i long, g string, v int").repartition(6)
    at = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles(df, "v", at, ["g"]).collect()}
    for g in {r[1] for r in rows}:
        assert got[g] == pytest.approx(np.quantile([v for _, h, v in rows if h == g and v is not None], at).tolist())
    whole = quantiles(df, "v", at).first()["quantiles"]
    assert whole == pytest.approx(np.quantile([r[2] for r in rows if r[2] is not None], at).tolist())
    assert quantiles(df.where("v is null"), "v", at).count() == 0 and quantiles(df.where("v is null"), "v", at, ["g"]).count() == 0
    ranks = {(r["g"], r["v"]): (r["n"], r["below"], r["total"], r["average_rank"]) for r in value_ranks(df, "v", ["g"]).collect()}
    for g, v in {(g, v) for _, g, v in rows if v is not None}:
        own = sorted(x for _, h, x in rows if h == g and x is not None)
        places = [k for k, x in enumerate(own, 1) if x == v]
        assert ranks[g, v] == (len(places), places[0] - 1, len(own), sum(places) / len(places))


def test_adjusted_p_values(spark, many_ranges):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "x", None]), rng.choice([0.001, 0.01, rng.random()])) for i in range(200)]
    df = spark.createDataFrame(rows, "name long, family string, p double").repartition(5)

    def plain(own):
        own, least, out = sorted(own, key=lambda r: (r[2], r[0])), 1.0, {}
        for k in range(len(own), 0, -1):
            least = min(least, own[k - 1][2] * len(own) / k)
            out[own[k - 1][0]] = (k, pytest.approx(least))
        return out

    got = {r["name"]: (r["rank"], r["q"]) for r in drift.adjust_bh(df, "family").collect()}
    assert all(got[n] == v for f in {r[1] for r in rows} for n, v in plain([r for r in rows if r[1] == f]).items())
    assert {r["name"]: (r["rank"], r["q"]) for r in drift.adjust_bh(df.drop("family")).collect()} == plain(rows)


def test_families_are_all_held_out(spark):
    rows = [(f"f{i}", True) for i in range(1300)] + [("f1", False)]
    got = evaluation.leave_one_family_out(spark.createDataFrame(rows, "family string, attacked boolean"))
    assert got.select("held").distinct().count() == 1300
    assert got.where("held = 'f7' and part = 'test'").count() == 2
    assert evaluation.leave_one_family_out(spark.createDataFrame([("x", False)], "family string, attacked boolean")).count() == 0


def test_permutation_test(spark):
    rng = np.random.default_rng(5)
    groups = rng.integers(0, 4, 400)
    flags = rng.random(400) < 0.25 + 0.06 * (groups == 2)
    df = spark.createDataFrame([(f"g{g}", bool(f)) for g, f in zip(groups, flags, strict=True)] + [(None, True), ("g1", None)], "g string, f boolean")
    row = resampling.permutation_test(df, "g", "f", draws=4000, seed=1).first()
    size = np.bincount(groups)
    seen = resampling.pearson(np.bincount(groups, flags, 4), size)[0]
    shuffled = np.array([resampling.pearson(np.bincount(groups, rng.permutation(flags), 4), size)[0] for _ in range(4000)])
    assert row["statistic"] == pytest.approx(seen) and row["n"] == 400
    assert row["p"] == pytest.approx((1 + (shuffled >= seen - 1e-9).sum()) / 4001, abs=0.035)
    assert resampling.permutation_test(df.repartition(7), "g", "f", draws=4000, seed=1).first()["p"] == row["p"]
    assert resampling.permutation_test(df.where("g = 'g1'"), "g", "f").first()["p"] == 1.0 and resampling.permutation_test(df.limit(0), "g", "f").first()["p"] == 1.0


def test_bootstraps(spark, many_ranges):
    rng = np.random.default_rng(6)
    scores = rng.normal(size=300).round(1)
    attacked = rng.random(300) < 1 / (1 + np.exp(-1.5 * scores))
    df = spark.createDataFrame([("k", float(s), bool(a)) for s, a in zip(scores, attacked, strict=True)] + [("one", 1.0, True)], "family string, score double, attacked boolean").repartition(4)
    got = {r["family"]: r for r in resampling.bootstrap_auroc(df, "family", draws=1500, seed=3).collect()}

    def area(s, y):
        pos, neg = s[y], s[~y]
        return (np.searchsorted(np.sort(neg), pos, "left") + np.searchsorted(np.sort(neg), pos, "right")).mean() / (2 * len(neg))

    plain = []
    for _ in range(1500):
        pick = rng.integers(0, 300, 300)
        plain.append(area(scores[pick], attacked[pick]))
    row = got["k"]
    assert row["auroc"] == pytest.approx(area(scores, attacked)) and got["one"]["auroc"] is None
    assert [row["low"], row["high"]] == pytest.approx(np.quantile(plain, [0.025, 0.975]), abs=0.012)
    again = resampling.bootstrap_auroc(df.repartition(3), "family", draws=1500, seed=3).where("family = 'k'").first()
    assert (again["low"], again["high"]) == (pytest.approx(row["low"]), pytest.approx(row["high"]))
    rates = {r["family"]: r for r in resampling.bootstrap_rates(df, "family", "attacked").collect()}
    share = attacked.mean()
    assert rates["k"]["rate"] == pytest.approx(share)
    assert [rates["k"]["low"], rates["k"]["high"]] == pytest.approx([np.quantile([rng.choice(attacked, 300).mean() for _ in range(2000)], q) for q in (0.025, 0.975)], abs=0.012)
    assert rates["one"]["n"] == 1 and rates["one"]["low"] > 0.1


def test_few_groups_meet_their_rows_where_they_lie(spark):
    """Edges of a few axes are sent to the rows, not the rows of an axis to one task."""
    from veristrata.operators import drift

    values = spark.range(300).selectExpr("concat('a', id % 3) axis", "cast(id % 2 as int) batch", "cast(id as double) value")
    assert "strategy=broadcast" in drift.bin_counts(values)._jdf.queryExecution().optimizedPlan().toString()
