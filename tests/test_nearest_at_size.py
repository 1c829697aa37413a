"""The nearest-neighbour search over several partitions, and where cells leave nothing out."""

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.test_nearest import found, plain, same_neighbours
from veristrata.operators import similarity
from veristrata.plans import queries


@pytest.fixture
def apart(spark):
    """No two shuffle partitions are read as one: what is hashed apart stays apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("sent", [4, 0])
@pytest.mark.parametrize("name", ["J03_knn", "A28_label_agreement", "J02_confirmed_pairs"])
def test_queries_over_partitions(spark, same, apart, monkeypatch, name, sent):
    monkeypatch.setattr(similarity, "MOST_SENT", sent)
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_cells_over_partitions(spark, apart, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 5
    x = centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8)) * 0.05
    monkeypatch.setattr(similarity, "_pass_by", None)  # cells do
    same_neighbours(found(spark, x, x, 5, True, block=16, pivot_rows=20), plain(x, x, 5, True))


def test_rows_without_clusters_are_not_copied_to_cells(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(600, 16))
    x[:9] = x[0]
    sent, real, packed = [], similarity._meet, similarity._packed
    monkeypatch.setattr(similarity, "_meet", lambda asked, *rest: sent.append(asked.count()) or real(asked, *rest))
    monkeypatch.setattr(similarity, "_packed", lambda rows, *rest: sent.append(rows.count()) or packed(rows, *rest))
    got = found(spark, x, x, 5, True, block=32, pivot_rows=20)
    same_neighbours(got, plain(x, x, 5, True))
    assert sent == [600, 600, 600]  # own cells, then each query and each row once; 30 cells would take 17,000 queries more
    assert [i for i, _ in got[8]] == [0, 1, 2, 3, 4]  # copies are as near as each other, whichever blocks hold them


def test_other_tables_pass_by(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MOST_SENT", 0)
    rng = np.random.default_rng(8)
    q, r = rng.normal(size=(30, 4)), rng.normal(size=(70, 4))
    q[3] = r[5] = 0
    same_neighbours(found(spark, q, r, 4, False, block=16, pivot_rows=10), plain(q, r, 4, False))
    same_neighbours(found(spark, r[:3], r[:3], 5, True, block=2), plain(r[:3], r[:3], 5, True))


def test_one_frame_is_dealt_and_packed_once(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(600, 16))
    x[:9], x[20:22] = x[0], 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    cuts, real = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: cuts.append(sorted(df.columns)) or real(df))
    got: dict = {}
    for row in similarity.nearest(frame, frame, 5, block=32, pivot_rows=20).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["id"], row["cosine"]))
    same_neighbours(got, plain(x, x, 5, True))
    assert [i for i, _ in got[8]] == [0, 1, 2, 3, 4]
    # of the vectors two copies are written, dealt and packed; before, each side had its own of both
    assert [c for c in cuts if {"vector", "vectors"} & set(c)] == [["away", "cell", "id", "vector"], ["block", "ids", "vectors"]]


@pytest.mark.parametrize("name", ["J03_knn", "A28_label_agreement", "J02_confirmed_pairs"])
def test_queries_give_one_frame(spark, monkeypatch, name):
    given, real = [], similarity.nearest
    monkeypatch.setattr(similarity, "nearest", lambda q, r, *rest, **more: given.append(q is r) or real(q, r, *rest, **more))
    queries.QUERIES[name](spark, SMALL)
    assert given == [True]
