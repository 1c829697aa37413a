"""Priors and negative space against literal formulas, one group at a time."""

import math
import random

import numpy as np
import pytest

from veristrata.functions import stats
from veristrata.operators import labels, risk


def clip(x):
    return min(max(x, 1e-4), 1 - 1e-4)


def prior(n, k, kept):
    """Rate and strength from the kept groups, by the moment formula over a loop."""
    if len(kept) < 2 or not sum(n[i] for i in kept):
        return clip(sum(k) / sum(n)), 10.0
    total = sum(n[i] for i in kept)
    p = clip(sum(k[i] for i in kept) / total)
    size = (total - sum(n[i] ** 2 for i in kept) / total) / (len(kept) - 1)
    if size <= 1:
        return p, 10.0
    x2 = sum(n[i] * (k[i] / n[i] - p) ** 2 for i in kept) / (p * (1 - p))
    rho = min(max((x2 / (len(kept) - 1) - 1) / (size - 1), 1e-6), 1.0)
    return p, min(max(1 / rho - 1, 2.0), 200.0)


@pytest.mark.parametrize("seed", range(6))
def test_priors(seed):
    rng = random.Random(seed)
    groups = rng.choice((1, 2, 3, 30))
    top = 1 if seed == 1 else 60
    n = [rng.randint(1, top) for _ in range(groups)]
    k = [rng.randint(0, x) if rng.random() < 0.7 else 0 for x in n]
    baseline = [rng.random() < 0.8 for _ in n]
    rate, strength = risk.priors_without_own(np.array(n), np.array(k), np.array(baseline))
    for i in range(groups):
        want = prior(n, k, [j for j in range(groups) if baseline[j] and j != i])
        assert (rate[i], strength[i]) == (pytest.approx(want[0]), pytest.approx(want[1], rel=1e-6))


def test_single_samples_tell_no_strength():
    rate, strength = risk.priors_without_own(np.ones(8, dtype=int), np.array([1, 0, 0, 0, 0, 0, 0, 0]), np.ones(8, dtype=bool))
    assert set(strength) == {10.0} and rate[0] == pytest.approx(1e-4) and rate[1] == pytest.approx(1 / 7)


def test_negative_space(spark):
    counts = {"a": (200, 4), "b": (150, 3), "c": (120, 60), "tiny": (6, 6), "d": (9, 0)}
    rows = spark.createDataFrame([(c, i < k) for c, (n, k) in counts.items() for i in range(n)] + [(None, True)] * 50, "contributor string, missed boolean")
    got = {r["contributor"]: r for r in labels.negative_space(rows.where("missed"), rows).collect()}
    assert set(got) == set(counts)
    for c, (n, k) in counts.items():
        peers = [counts[o] for o in counts if o != c and counts[o][0] >= 10]
        rn, rk, worst = sum(x for x, _ in peers), sum(y for _, y in peers), max(y / x for x, y in peers)
        p = min(1.0, stats.fisher_greater(k, n - k, rk, rn - rk) * len(counts))
        assert got[c]["worst_peer"] == pytest.approx(worst) and math.isclose(got[c]["p"], p, rel_tol=1e-9)
        assert got[c]["flagged"] == (k >= 5 and k / n >= 0.15 and k / n >= 3 * max(worst, 0.02) and p < 1e-3)
    assert got["c"]["flagged"] and not got["a"]["flagged"]


def test_negative_space_alone(spark):
    rows = spark.createDataFrame([("a", True)] * 20, "contributor string, missed boolean")
    row = labels.negative_space(rows, rows).first()
    assert (row["n"], row["k"], row["worst_peer"], row["p"], row["flagged"]) == (20, 20, 0.0, 1.0, False)
    assert labels.negative_space(rows.limit(0), rows.limit(0)).count() == 0
