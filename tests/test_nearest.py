"""Exact nearest neighbours with cells: the same as all pairs, and little work on clustered data."""

import numpy as np
import pytest

from veristrata.operators import similarity


def plain(q, r, k, same):
    out = {}
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    s = unit(q) @ unit(r).T
    for i in range(len(q)):
        near = sorted(((-round(s[i, j], 9), j) for j in range(len(r)) if not (same and i == j)))[:k]
        out[i] = [(j, -d) for d, j in near]
    return out


def found(spark, q, r, k, same, **more):
    table = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    out: dict = {}
    for row in similarity.nearest(table(q), table(r), k, same_table=same, **more).orderBy("query_id", "rank").collect():
        out.setdefault(row["query_id"], []).append((row["id"], row["cosine"]))
    return out


def same_neighbours(got, want):
    assert got.keys() == {i for i, v in want.items() if v}
    for i, near in got.items():
        assert [c for _, c in near] == pytest.approx([c for _, c in want[i]], abs=1e-8)
        # ids agree but among equal cosines, where rounding may tell
        assert {j for j, c in near if c > want[i][-1][1] + 1e-8} == {j for j, c in want[i] if c > want[i][-1][1] + 1e-8}


@pytest.mark.parametrize("kind", ["clusters", "noise", "hot"])
def test_same_as_all_pairs(spark, kind, monkeypatch):
    rng = np.random.default_rng(4)
    if kind == "noise":
        x = rng.normal(size=(300, 6))
    else:
        centres = rng.normal(size=(12, 8)) * 5
        x = centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8)) * 0.05
    if kind == "hot":
        x[:140] = x[0]  # a third and more are copies of one vector
        x[200:203] = 0
    counted = []
    real = similarity._meet
    monkeypatch.setattr(similarity, "_meet", lambda asked, *rest: counted.append(asked.count()) or real(asked, *rest))
    got = found(spark, x, x, 5, True, block=64, pivot_rows=20)
    same_neighbours(got, plain(x, x, 5, True))
    if kind == "clusters":  # a query asks for few of the 20 cells besides its own
        assert counted[0] == 400 and counted[1] < 400 * 19 / 4


def test_other_tables_and_few_rows(spark):
    rng = np.random.default_rng(5)
    q, r = rng.normal(size=(30, 4)), rng.normal(size=(70, 4))
    q[3] = 0
    same_neighbours(found(spark, q, r, 4, False, block=16, pivot_rows=10), plain(q, r, 4, False))
    same_neighbours(found(spark, r[:3], r[:3], 5, True), plain(r[:3], r[:3], 5, True))
    assert found(spark, r[:1], r[:1], 5, True) == {} and found(spark, q, r[:0], 3, False) == {} and found(spark, q[:0], r, 3, False) == {}
