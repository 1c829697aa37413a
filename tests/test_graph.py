"""Connected components against a plain search, with hubs, chains and odd rows."""

import random

import pytest

from veristrata.operators import graph


def brute(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = {}
    for start in sorted(near):
        if start not in label:
            stack = [start]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = start
                    stack += near[x]
    return label


def graphs():
    rng = random.Random(4)
    star = [(0, i) for i in range(1, 400)] + [(500 + i, 999) for i in range(300)]
    chain = [(i, i + 1) for i in range(600)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    ends = [(rng.randrange(-(1 << 62), 1 << 62), 7) for _ in range(50)]
    return {"star": star, "chain": rng.sample(chain, len(chain)), "loose": loose, "ends": ends, "odd": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None)], "empty": []}


@pytest.mark.parametrize("finish", [0, 300])
@pytest.mark.parametrize("name", sorted(graphs()))
def test_components(spark, monkeypatch, name, finish):
    monkeypatch.setattr(graph, "HUBS", 20)
    monkeypatch.setattr(graph, "FINISH", finish)
    edges = graphs()[name]
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    rows = got.collect()
    assert {r["vertex"]: r["component"] for r in rows} == brute(edges) and len(rows) == len(brute(edges))


def test_unsettled_components_raise(spark, monkeypatch):
    monkeypatch.setattr(graph, "FINISH", 0)
    with pytest.raises(RuntimeError):
        graph.connected_components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").repartition(40), most_rounds=1)
