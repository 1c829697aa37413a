"""Resampling from counts: permutation tests and bootstraps whose cost doesn't grow with the rows behind a count.

Draws are spread over tasks. Each has a seed of its own, made from the seed given
and from what it draws for, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.functions import stats

#: Draws of a task, at most, and groups that a permutation test may have.
BLOCK, MOST_GROUPS = 500, 1_000_000
#: From so many rows on, draws without replacement are beyond numpy's whole numbers, and the chi-square limit stands for them.
MOST_ROWS = 10**9
LEVEL = (0.025, 0.975)


def _seed(seed: int, *parts: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *parts)).encode()).digest()[:16], "big"))


def pearson(flagged: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Statistic of unequal shares; ``flagged``: a table a row."""
    flagged = np.atleast_2d(flagged).astype(float)
    share = flagged.sum(1, keepdims=True) / size.sum()
    expected = size * share
    return ((flagged - expected) ** 2 / np.maximum(expected * (1 - share), 1e-300)).sum(1)


def permutation_test(rows: DataFrame, group: str, flag: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Does the share of ``flag`` differ between groups? One row: ``groups``, ``n``, ``flagged``, ``statistic``, ``p``, ``method``.

    Shuffled flags change only how many fall into each group, so tables are drawn
    from the groups' sizes (multivariate hypergeometric). Nulls of either column
    are left out. One group, or one kind of flag, gives p = 1.
    """
    spark = rows.sparkSession
    counted = rows.where(F.col(group).isNotNull() & F.col(flag).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("k"))
    held = counted.orderBy(group).limit(MOST_GROUPS + 1).select("n", "k").toPandas()
    if len(held) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    size, k = held["n"].to_numpy(np.int64), held["k"].to_numpy(np.int64)
    n, flagged = int(size.sum()), int(k.sum())
    shape = "groups long, n long, flagged long, statistic double, p double, method string"
    if len(size) < 2 or flagged in (0, n):
        return spark.createDataFrame([(len(size), n, flagged, 0.0, 1.0, "none")], shape)
    seen = float(pearson(k, size)[0])
    if n >= MOST_ROWS:
        return spark.createDataFrame([(len(size), n, flagged, seen, stats.chi_square_tail(seen, len(size) - 1), "chi-square")], shape)
    shared = spark.sparkContext.broadcast(size)

    def draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["id"]:
                tables = _seed(seed, "tables", int(block)).multivariate_hypergeometric(shared.value, flagged, size=min(BLOCK, draws - int(block) * BLOCK))
                yield pd.DataFrame({"hits": [int((pearson(tables, shared.value) >= seen - 1e-9).sum())]})

    blocks = -(-draws // BLOCK)
    hits = spark.range(0, blocks, 1, blocks).mapInPandas(draw, "hits long").agg(F.sum("hits").alias("hits"))
    return hits.select(F.lit(len(size)).cast("long").alias("groups"), F.lit(n).cast("long").alias("n"), F.lit(flagged).cast("long").alias("flagged"), F.lit(seen).alias("statistic"), ((F.col("hits") + 1) / (draws + 1)).alias("p"), F.lit("permutation").alias("method"))


def bootstrap_rates(rows: DataFrame, group: str, flag: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Share of ``flag`` by group with a percentile interval: ``n``, ``k``, ``rate``, ``low``, ``high``. Groups of fewer than ten rows get the score interval."""

    @F.pandas_udf("low double, high double")
    def interval(name: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
        out = []
        for g, size, hits in zip(name, n, k, strict=True):
            if size < 10:
                out.append(stats.wilson(int(hits), int(size), 0.95))
            else:
                out.append(tuple(np.quantile(_seed(seed, "rate", g).binomial(int(size), hits / size, draws) / size, LEVEL)))
        return pd.DataFrame(out, columns=["low", "high"])

    counted = rows.where(F.col(flag).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("k"))
    return counted.withColumn("i", interval(F.col(group).cast("string"), "n", "k")).select(group, "n", "k", (F.col("k") / F.col("n")).alias("rate"), "i.low", "i.high")


def bootstrap_auroc(rows: DataFrame, by: str | None = None, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile interval of the area under the curve: ``auroc``, ``low``, ``high``. ``rows``: score, attacked.

    Equal scores are one cell, whose weight in a draw is Poisson of its count. A
    range of scores gives each draw three sums (attacked, clean, and pairs won
    inside it); ranges add up by what lies below them. No task sees all scores.
    """
    keys = [by] if by else []
    cells = rows.where(F.col("score").isNotNull() & F.col("attacked").isNotNull()).groupBy(*keys, F.col("score").cast("double").alias("score")).agg(F.count_if("attacked").alias("pos"), F.count_if(~F.col("attacked")).alias("neg"))
    dealt = cells.withColumn("g", F.col(by).cast("string") if by else F.lit("")).select("g", "score", "pos", "neg").repartitionByRange("g", "score").sortWithinPartitions("g", "score")

    def draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, p, n, u = None, 0.0, None, None, None

        def sums() -> pd.DataFrame:
            return pd.DataFrame({"g": at, "first": first, "draw": np.arange(draws + 1), "p": p, "n": n, "u": u})

        for batch in batches:
            for g, score, pos, neg in batch.itertuples(index=False):
                if p is None or g != at:
                    if p is not None:
                        yield sums()
                    at, first, p, n, u = g, score, np.zeros(draws + 1), np.zeros(draws + 1), np.zeros(draws + 1)
                rng = _seed(seed, g, struct.pack(">d", score))
                a, b = np.concatenate([[pos], rng.poisson(pos, draws)]), np.concatenate([[neg], rng.poisson(neg, draws)])  # the first is what was seen
                u += a * (n + b / 2)
                p += a
                n += b
        if p is not None:
            yield sums()

    ranges = dealt.mapInPandas(draw, "g string, first double, draw int, p double, n double, u double")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("g", "draw").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    area = ranges.withColumn("u", F.col("u") + F.col("p") * below).groupBy("g", "draw").agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("n")).alias("area"))
    out = area.groupBy("g").agg(F.max(F.when(F.col("draw") == 0, F.col("area"))).alias("auroc"), F.percentile(F.when(F.col("draw") > 0, F.col("area")), F.array(*map(F.lit, LEVEL))).alias("q"))  # draws + 1 rows a group
    return out.select(*([F.col("g").alias(by)] if by else []), "auroc", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
