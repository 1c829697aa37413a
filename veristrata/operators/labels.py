"""Label errors, outliers of a class, and detection matching."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.functions import stats
from veristrata.operators.cohorts import iou


def out_of_fold(rows: DataFrame, folds: int = 5, group: str | None = None) -> DataFrame:
    """Class probabilities from a linear probe that hasn't seen the row's fold: id, label, probs. ``rows``: id, vector, label (from 0).

    Folds are drawn by a hash of the id, or of a group that must stay together.
    """
    data = rows.select("id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("vector").cast("array<double>")).alias("features"), F.pmod(F.xxhash64(group or "id", F.lit(3)), F.lit(folds)).alias("fold"))
    out = None
    for k in range(folds):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        if train.isEmpty() or test.isEmpty():
            continue
        model = LogisticRegression(maxIter=50, regParam=1e-3, family="multinomial").fit(train)
        part = model.transform(test).select("id", F.col("label").cast("int").alias("label"), vector_to_array("probability").alias("probs"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "id long, label int, probs array<double>")


def class_thresholds(probs: DataFrame) -> DataFrame:
    """Mean self-confidence by class."""
    return probs.groupBy("label").agg(F.avg(F.get("probs", F.col("label"))).alias("threshold"))


def confident_errors(probs: DataFrame) -> DataFrame:
    """Confident learning (Northcutt et al., 2021): rows whose most probable class, of those at or above their class's threshold, isn't their label and is more probable than it; the largest margin first."""
    t = {r["label"]: r["threshold"] for r in class_thresholds(probs).collect()}  # one number a class
    if not t:
        return probs.sparkSession.createDataFrame([], "id long, label int, suggested int, margin double")
    limits = F.array(*(F.lit(float(t.get(c, 2.0))) for c in range(max(t) + 1)))
    each = F.transform("probs", lambda p, i: F.when(p >= F.get(limits, i), p).otherwise(-1.0))
    best = probs.withColumn("above", each).withColumn("suggested", (F.array_position("above", F.array_max("above")) - 1).cast("int")).where(F.array_max("above") >= 0)
    wrong = best.where(F.col("suggested") != F.col("label"))
    return wrong.select("id", "label", "suggested", (F.get("probs", F.col("suggested")) - F.get("probs", F.col("label"))).alias("margin")).where("margin > 0").orderBy(F.desc("margin"), "id")


def spectral_scores(rows: DataFrame, least: int = 20, power: int = 30) -> DataFrame:
    """Squared projection of each row on its class's first principal direction: id, label, score. ``rows``: id, label, vector.

    Means and covariance steps are sums over rows, so a class of any size stays distributed: power iteration needs one pass for the moments.
    """
    dim = rows.select(F.size("vector").alias("d")).first()
    if dim is None:
        return rows.sparkSession.createDataFrame([], "id long, label int, score double")

    def moments(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for label, part in batch.groupby("label"):
                x = np.stack(part["vector"].to_numpy()).astype(float)
                n, s, c = total.get(label, (0, 0.0, 0.0))
                total[label] = (n + len(x), s + x.sum(0), c + x.T @ x)
        yield pd.DataFrame([(k, n, s.tolist(), c.ravel().tolist()) for k, (n, s, c) in total.items()], columns=["label", "n", "s", "c"])

    parts = rows.select("label", "vector").mapInPandas(moments, "label int, n long, s array<double>, c array<double>")
    whole = F.concat(F.array(F.col("n").cast("double")), "s", "c")
    summed = parts.select("label", F.posexplode(whole).alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x"))
    moment = summed.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda m: m["x"]).alias("m"))
    found = []
    for label, m in moment.collect():  # one matrix a class, whatever the number of tasks
        n, d = int(m[0]), (math.isqrt(4 * len(m) - 3) - 1) // 2
        if n >= least:
            mean = np.array(m[1 : d + 1]) / n
            cov = np.array(m[d + 1 :]).reshape(d, d) / n - np.outer(mean, mean)
            v = np.ones(d) / np.sqrt(d)
            for _ in range(power):
                v = cov @ v
                v /= max(np.linalg.norm(v), 1e-300)
            found.append((int(label), mean.tolist(), v.tolist()))
    axes = rows.sparkSession.createDataFrame(found, "label int, mean array<double>, axis array<double>")
    shifted = F.aggregate(F.zip_with(F.zip_with("vector", "mean", lambda a, b: a - b), "axis", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.join(axes, "label").select("id", "label", (shifted * shifted).alias("score"))


def heavy_contributors(rows: DataFrame, least: int = 10, share: float = 0.2) -> DataFrame:
    """Contributors of whose rows many are flagged. ``rows``: contributor, flagged."""
    g = rows.groupBy("contributor").agg(F.count("*").alias("n"), F.count_if("flagged").alias("k"))
    return g.withColumn("share", F.col("k") / F.col("n")).withColumn("heavy", (F.col("k") >= least) & (F.col("share") >= share))


def negative_space(missed: DataFrame, detections: DataFrame, least_rate: float = 0.15, factor: float = 3.0, floor: float = 0.02, alpha: float = 1e-3, least_missed: int = 5, least_peer: int = 10) -> DataFrame:
    """Contributors who leave out more objects than their worst peer by ``factor``. Both: contributor (one row a detection).

    Peers are contributors of ``least_peer`` rows or more. Their sums are totals
    less the contributor's own, the worst is the first or second of an ordered
    window of one short row a contributor; p-values are corrected over all
    contributors. Rows without a contributor take no part.
    """
    counts = detections.where("contributor is not null").groupBy("contributor").agg(F.count("*").alias("n"))
    g = counts.join(missed.groupBy("contributor").agg(F.count("*").alias("k")), "contributor", "left").fillna(0, ["k"])
    peer = F.col("n") >= least_peer
    g = g.withColumn("rate", F.col("k") / F.col("n")).withColumn("as_peer", F.when(peer, F.col("rate")))
    every, order = Window.partitionBy(), Window.orderBy(F.desc_nulls_last("as_peer"), "contributor")
    own = lambda c: F.when(peer, F.col(c)).otherwise(0)
    worst = F.when(F.row_number().over(order) == 1, F.lead("as_peer").over(order)).otherwise(F.first("as_peer").over(order))
    g = g.withColumn("worst_peer", worst).withColumn("rest_n", F.sum(own("n")).over(every) - own("n")).withColumn("rest_k", F.sum(own("k")).over(every) - own("k"))
    g = g.withColumn("family", F.count("*").over(every))

    @F.pandas_udf("double")
    def p(a: pd.Series, n: pd.Series, c: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([stats.fisher_greater(int(w), int(x - w), int(y), int(z - y)) if z else 1.0 for w, x, y, z in zip(a, n, c, m, strict=True)])

    out = g.withColumn("p", F.least(F.lit(1.0), p("k", "n", "rest_k", "rest_n") * F.col("family")))
    stands = (F.col("rate") >= least_rate) & (F.col("rate") >= factor * F.greatest("worst_peer", F.lit(floor))) & (F.col("k") >= least_missed) & (F.col("p") < alpha)
    return out.select("contributor", "n", "k", "rate", F.coalesce("worst_peer", F.lit(0.0)).alias("worst_peer"), "p", ((F.col("rest_n") > 0) & stands).alias("flagged"))


def best_missed(detections: DataFrame, boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """Without contributors: each sample's most certain detection that overlaps no box. ``detections``: sample_id, det_id, score and box."""
    d, b = detections.alias("d"), boxes.alias("b")
    free = d.join(b, (F.col("d.sample_id") == F.col("b.sample_id")) & (iou("d", "b") >= least), "left_anti")
    return free.groupBy("sample_id").agg(F.max_by("det_id", F.struct("score", -F.col("det_id"))).alias("det_id"), F.max("score").alias("score"))


def match_detections(sealed: DataFrame, again: DataFrame, slack: float = 1 + 2 / 64) -> DataFrame:
    """Greedy matching of a record's boxes with recomputed ones: same class, corners within ``slack`` pixels, each used once. Both: record_id, cls, x, y, w, h."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, used, hits = b.to_dict("records"), set(), 0
        for s in a.sort_values(["cls", "x", "y", "w", "h"]).itertuples():
            best = None
            for i, t in enumerate(left):
                if i not in used and t["cls"] == s.cls:
                    d = max(abs(t["x"] - s.x), abs(t["y"] - s.y), abs(t["x"] + t["w"] - s.x - s.w), abs(t["y"] + t["h"] - s.y - s.h))
                    if d <= slack and (best is None or d < best[0]):
                        best = (d, i)
            if best:
                used.add(best[1])
                hits += 1
        key = a["record_id"].iloc[0] if len(a) else b["record_id"].iloc[0]
        return pd.DataFrame([(key, len(a), len(b), hits, hits == len(a) == len(b))], columns=["record_id", "sealed", "again", "matched", "whole"])

    return sealed.groupBy("record_id").cogroup(again.groupBy("record_id")).applyInPandas(run, "record_id string, sealed long, again long, matched long, whole boolean")
