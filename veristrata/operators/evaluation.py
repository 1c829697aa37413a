"""Evaluation of detectors over labelled subjects."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions import stats
from veristrata.operators.running import running

#: Families of attacks that are held out in turn.
MOST_FAMILIES = 100_000
Z95 = stats.normal_quantile(0.975)


def wilson_columns(k: Column, n: Column) -> tuple[Column, Column]:
    """The score interval as columns."""
    p = F.try_divide(k, n)
    z2 = Z95 * Z95
    middle = (p + z2 / (n * 2)) / (F.lit(1.0) + z2 / n)
    half = F.lit(Z95) / (F.lit(1.0) + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (n * n * 4))
    return F.greatest(F.lit(0.0), F.least(middle - half, p)), F.least(F.lit(1.0), F.greatest(middle + half, p))


def auroc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the curve and Cliff's delta, ties counted half. ``rows``: score, attacked.

    Equal scores are combined first; average ranks follow from running counts over ranges of scores.
    """
    by = by or []
    each = rows.groupBy(*by, "score").agg(F.count_if("attacked").alias("pos"), F.count_if(~F.col("attacked")).alias("neg"))
    wins = running(each, ["score"], {"upto": ("sum", F.col("neg"))}, by).withColumn("less", F.col("upto") - F.col("neg"))
    out = wins.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("less") + F.col("neg") * 0.5)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    area = F.try_divide(F.col("u"), F.col("n_pos") * F.col("n_neg"))
    return out.select(*by, "n_pos", "n_neg", area.alias("auroc"), (area * 2 - 1).alias("cliffs_delta"))


def pick_threshold(rows: DataFrame, most_false: float = 0.05, points: int = 200) -> DataFrame:
    """Of an even grid of thresholds, the one of most hits with few enough false alarms; the first of equals.

    Scores are counted by grid place, so the grid isn't joined with the rows.
    """
    span = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi = float(span["lo"] or 0.0), float(span["hi"] or 0.0)
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    score = F.col("score")
    # the place by division, put right where rounding is off by one
    guess = F.floor((score - lo) / ((hi - lo) or 1.0) * (points - 1)).cast("int")
    line = lambda i: F.lit(lo) + F.lit(hi - lo) * i / (points - 1)
    place = F.when(line(guess) > score, guess).when((guess < points - 1) & (line(guess + 1) <= score), guess + 2).otherwise(guess + 1)
    counted = rows.withColumn("place", F.lit(points) if hi == lo else place).groupBy("place").agg(F.count_if("attacked").alias("pos"), F.count_if(~F.col("attacked")).alias("neg"))
    table = {r["place"]: (r["pos"], r["neg"]) for r in counted.collect()}  # points + 1 rows at most
    pos, neg = sum(v[0] for v in table.values()), sum(v[1] for v in table.values())
    best = None
    for i, g in enumerate(grid):
        hit = sum(v[0] for p, v in table.items() if p > i) / max(1, pos)
        false = sum(v[1] for p, v in table.items() if p > i) / max(1, neg)
        if false <= most_false and (best is None or hit > best[1]):
            best = (g, hit, false)
    return rows.sparkSession.createDataFrame([best] if best else [], "threshold double, tpr double, fpr double")


def leave_one_family_out(rows: DataFrame) -> DataFrame:
    """For each family with attacked rows: the other families' attacked rows as ``train``, its own as ``test``; clean rows in both.

    Every row goes into the split of every family, as the method asks: the result
    is as many times the input. More than ``MOST_FAMILIES`` are an error, none is
    left out.
    """
    families = [r["family"] for r in rows.where("attacked and family is not null").groupBy("family").count().limit(MOST_FAMILIES + 1).collect()]
    if len(families) > MOST_FAMILIES:
        raise ValueError(f"more than {MOST_FAMILIES} families: one model each is no plan")
    both = rows.withColumn("held", F.explode(F.from_json(F.lit(json.dumps(sorted(families))), "array<string>")))  # one literal, however many
    part = F.when(~F.col("attacked"), F.array(F.lit("train"), F.lit("test"))).when(F.col("family") == F.col("held"), F.array(F.lit("test"))).otherwise(F.array(F.lit("train")))
    return both.withColumn("part", F.explode(part))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """``pairs``: right_a, right_b (boolean). Discordant counts and the exact two-sided p-value."""

    @F.pandas_udf("double")
    def p(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([stats.mcnemar_exact(int(x), int(y)) for x, y in zip(b, c, strict=True)])

    counted = pairs.agg(F.count_if(F.col("right_a") & ~F.col("right_b")).alias("only_a"), F.count_if(~F.col("right_a") & F.col("right_b")).alias("only_b"))
    return counted.withColumn("p", p("only_a", "only_b"))


def scoreboard(rows: DataFrame) -> DataFrame:
    """Detection and false-alarm share by detector with intervals. ``rows``: detector_id, attacked, fired."""
    g = rows.groupBy("detector_id").agg(F.count_if("attacked").alias("n_attacked"), F.count_if(F.col("attacked") & F.col("fired")).alias("detected"), F.count_if(~F.col("attacked")).alias("n_clean"), F.count_if(~F.col("attacked") & F.col("fired")).alias("false_alarms"))
    low, high = wilson_columns(F.col("detected").cast("double"), F.col("n_attacked").cast("double"))
    return g.withColumn("detection_rate", F.try_divide("detected", "n_attacked")).withColumn("false_alarm_rate", F.try_divide("false_alarms", "n_clean")).withColumn("ci_low", low).withColumn("ci_high", high)


def variance_decomposition(rows: DataFrame, least_ratio: float = 4.0) -> DataFrame:
    """Between- and within-group sample variance of ``value`` by ``setting``, and their ratio."""
    g = rows.groupBy("setting").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    out = g.agg(F.var_samp("m").alias("between"), F.avg("v").alias("within"))
    ratio = F.try_divide(F.col("between"), F.col("within"))
    return out.withColumn("ratio", ratio).withColumn("sensitive", F.coalesce(ratio >= least_ratio, F.lit(False)))


def ablation(whole: DataFrame, without: DataFrame, least: float = 0.01) -> DataFrame:
    """Change of AUROC with each part taken away. ``whole``: auroc; ``without``: part, auroc."""
    full = whole.select("auroc").first()[0]
    return without.withColumn("full", F.lit(full)).select("part", "auroc", (F.col("full") - F.col("auroc")).alias("loss")).withColumn("verdict", F.when(F.col("loss") > least, "helps").when(F.col("loss") < -least, "hurts").otherwise("no difference"))
