"""Connected components of an edge table, by alternating stars.

Edges are first contracted where they lie: each chunk of a partition becomes a
forest of stars. Then large-star hangs a vertex's larger neighbours on its
smallest one, and small-star does so with the smaller ones; after a few rounds
every vertex hangs on the smallest of its component.

A star's centre has as many edges as its component has vertices. Its smallest
neighbour is found by partial aggregation, and its edges don't meet in a task:
a vertex that holds more than a ``HUBS``-th of all edges is a hub, of which there
are at most ``HUBS``; hubs are broadcast to where the edges lie, and only other
vertices' edges are shuffled. Each round is cut off by a reliable checkpoint.
Once no more than ``FINISH`` edges are left, a bounded number whatever the input,
one task contracts the rest: rounds on so few cost more in tasks than in work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.sources.session import cut

#: A hub holds more than one in so many edges, so this bounds their number too.
HUBS = 2048
#: Edges that are contracted at once, and those that the last task finishes.
CHUNK, FINISH = 500_000, 200_000


def contract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A forest of stars with the components of each chunk of edges (u, v); the centre v is the smallest vertex."""
    for batch in batches:
        for part in (batch.iloc[i : i + CHUNK] for i in range(0, len(batch), CHUNK)):
            parent: dict[int, int] = {}

            def find(x: int, parent: dict[int, int] = parent) -> int:
                top = x
                while (up := parent.get(top, top)) != top:
                    top = up
                while x != top:
                    parent[x], x = top, parent[x]
                return top

            for a, b in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
                a, b = find(a), find(b)
                if a < b:
                    parent[b] = a
                elif b < a:
                    parent[a] = b
            below = list(parent)
            yield pd.DataFrame({"u": below, "v": [find(x) for x in below]}, dtype="int64")


def whole_forest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    yield from contract([pd.concat(parts)] if parts else [])


def with_least(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least v of each u. ``n``: at least a third of the number of edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(1, 3 * n // HUBS)
    hubs = least.where(hub).select("u", "m")  # fewer than HUBS rows: each holds more than a HUBS-th of the edges
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest)


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``edges`` has long columns ``a`` and ``b``. Returns ``vertex`` and ``component`` (its smallest vertex) of every vertex that has an edge.

    Rounds are about the logarithm of the longest path; a RuntimeError is raised if ``most_rounds`` don't suffice.
    """
    whole = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct()
    now = cut(whole.mapInPandas(contract, "u long, v long").distinct())
    n, before = now.count(), None
    for _ in range(most_rounds):
        if n <= min(FINISH, CHUNK):
            # at most FINISH rows, in one batch: a forest of stars is the result
            now = cut(now.coalesce(1).mapInPandas(whole_forest, "u long, v long"))
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # every edge now runs from the larger vertex u to the smaller v
        small = with_least(large, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before:
            break
        n, before = seen[0], seen
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    # settled: each vertex but a component's smallest has one edge, to that
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
