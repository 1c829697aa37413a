"""From findings to decisions: rule tables, calibration, group risk, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.functions import stats

# Orders of severities and dispositions.
SEVERITIES = ("info", "low", "medium", "high", "critical")
DISPOSITIONS = ("accept", "review", "quarantine")
#: Groups are outliers of the prior below this tail probability.
OUTLIER = 1e-3


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(order):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


@dataclass(frozen=True)
class Rule:
    """First match wins. ``attack_class`` matches exactly, by prefix (ending in ``*``), or ``module:X`` by the detector's module."""

    name: str
    attack_class: str
    outcome: str
    least_confidence: float | None = None
    least_severity: str | None = None
    cap: str | None = None

    def matches(self, calibrated: Column) -> Column:
        kind = F.col("attack_class")
        if self.attack_class == "*":
            hit = F.lit(True)
        elif self.attack_class.startswith("module:"):
            hit = F.substring_index("detector_id", ".", 1) == self.attack_class[7:]
        elif self.attack_class.endswith("*"):
            hit = kind.startswith(self.attack_class[:-1])
        else:
            hit = kind == self.attack_class
        if self.least_confidence is not None:
            # an uncalibrated confidence can't be held against a bar: the clause is passed over, and the outcome capped later
            hit = hit & (~calibrated | (F.col("confidence") >= self.least_confidence))
        if self.least_severity is not None:
            hit = hit & (rank_of(F.col("severity"), SEVERITIES) >= SEVERITIES.index(self.least_severity))
        return hit


DEFAULT_RULES = (
    Rule("R1", "copies*", "quarantine", least_confidence=0.9, least_severity="high"),
    Rule("R2", "copies*", "review", least_severity="medium"),
    Rule("R3", "drift*", "review", cap="review"),
    Rule("R4", "module:label", "review", least_confidence=0.5),
    Rule("R5", "*", "accept"),
)


def route(findings: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """``disposition`` and ``rule`` of each finding, as one generated CASE. Uncalibrated findings never go above review."""
    calibrated = F.coalesce(F.col("calibrated"), F.lit(False))
    outcome, name = F.lit("review"), F.lit("default")
    for rule in reversed(rules):
        hit = rule.matches(calibrated)
        result = rule.outcome
        if rule.cap is not None:
            result = DISPOSITIONS[min(DISPOSITIONS.index(rule.outcome), DISPOSITIONS.index(rule.cap))]
        value = F.lit(result)
        if result == "quarantine":
            value = F.when(calibrated, F.lit("quarantine")).otherwise(F.lit("review"))
        outcome, name = F.when(hit, value).otherwise(outcome), F.when(hit, F.lit(rule.name)).otherwise(name)
    return findings.withColumn("disposition", outcome).withColumn("rule", name)


def defer_digest(findings: DataFrame) -> DataFrame:
    """In a scan whose fingerprint check ran, findings of the digest check are informational."""
    ran = F.max((F.col("detector_id") == "model.fingerprint") & (F.col("availability") == "ran")).over(Window.partitionBy("scan_id"))
    return findings.withColumn("severity", F.when((F.col("detector_id") == "model.digest") & ran, F.lit("info")).otherwise(F.col("severity")))


def flagged_samples(findings: DataFrame) -> DataFrame:
    """Samples with a finding that ran and wasn't accepted."""
    return findings.where("target_type = 'sample' and availability = 'ran' and disposition <> 'accept'").select(F.col("target_ref").alias("sample_id")).distinct()


def fired(findings: DataFrame) -> DataFrame:
    return findings.where((F.col("availability") == "ran") & F.col("disposition").isin("review", "quarantine") & (rank_of(F.col("severity"), SEVERITIES) >= 2))


def verdict(findings: DataFrame) -> DataFrame:
    """One row a scan: quarantine, else review on an error or on a medium finding under review, else accept."""
    ran = F.col("availability") == "ran"
    return findings.groupBy("scan_id").agg(
        F.when(F.bool_or(ran & (F.col("disposition") == "quarantine")), "QUARANTINE")
        .when(F.bool_or(F.col("availability") == "error"), "REVIEW")
        .when(F.bool_or(ran & (F.col("disposition") == "review") & (rank_of(F.col("severity"), SEVERITIES) >= 2)), "REVIEW")
        .otherwise("ACCEPT").alias("verdict")
    )


def group_counts(samples: DataFrame, flagged: DataFrame, keys: tuple[str, ...] = ("contributor", "batch", "source")) -> DataFrame:
    """``kind``, ``group``, ``n`` and ``k`` (flagged) for every key, in one pass over the samples; null and empty keys are left out."""
    marked = samples.join(flagged.withColumn("__hit", F.lit(1)), "sample_id", "left")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("group")) for k in keys)))
    return marked.select(each.alias("g"), "__hit").select("g.kind", "g.group", "__hit").where("group is not null and group <> ''").groupBy("kind", "group").agg(F.count("*").alias("n"), F.count("__hit").alias("k"))


#: A prior's strength: the least and the most, and what stands where it can't be learnt.
STRENGTHS, WEAK = (2.0, 200.0), 10.0


def _clipped(rate: np.ndarray) -> np.ndarray:
    return np.clip(rate, 1e-4, 1 - 1e-4)


def priors_without_own(n: np.ndarray, k: np.ndarray, baseline: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rate and strength of each group's beta prior, learnt from the other groups of the baseline.

    All sums are totals less the group's own term. With fewer than two others the
    pooled rate and a strength of ``WEAK`` stand; so does that strength where every
    other group is a single sample, as spread can't be told then.
    """
    n, k, held = n.astype(float), k.astype(float), baseline.astype(float)
    share = np.divide(k * k, n, out=np.zeros_like(n), where=n > 0)

    def others(x: np.ndarray) -> np.ndarray:
        return (x * held).sum() - x * held

    groups, size, hits = others(np.ones_like(n)), others(n), others(k)
    learnt = (groups >= 2) & (size > 0)
    some = np.where(learnt, size, 1.0)
    pooled = k.sum() / n.sum() if n.sum() else 0.0
    rate = _clipped(np.where(learnt, hits / some, pooled))
    free = np.where(learnt, groups - 1, 1.0)
    mean_size = (size - others(n * n) / some) / free
    spread = others(share) - 2 * rate * hits + rate * rate * size
    told = learnt & (mean_size > 1 + 1e-12)
    rho = (spread / (rate * (1 - rate)) / free - 1) / np.where(told, mean_size - 1, 1.0)
    strength = np.where(told, np.clip(1 / np.clip(rho, 1e-6, 1.0) - 1, *STRENGTHS), WEAK)
    return rate, strength


def contributor_disposition(ci_low: Column, prior: Column, mean: Column, quarantine_mean: float = 0.25) -> Column:
    """Groups whose interval lies above what was expected are quarantined if their mean is high, else reviewed."""
    above = F.coalesce(ci_low > prior, F.lit(False))
    return F.when(above & (mean >= quarantine_mean), "quarantine").when(above, "review").otherwise("accept")


def rank_groups(counts: DataFrame, quarantine_mean: float = 0.25) -> DataFrame:
    """Every group's posterior share with a 95 % interval, ranked by the interval's low end.

    Groups that stand out of the pooled share (binomial tail below ``OUTLIER``)
    don't shape the prior of the others; each group's prior leaves the group
    itself out. The groups of a kind meet in one task: one short row each.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("group").reset_index(drop=True)
        n, k = part["n"].to_numpy(), part["k"].to_numpy()
        pooled = float(_clipped(np.float64(k.sum() / max(1, n.sum()))))
        stands = np.array([stats.binomial_tail(int(b), int(a), pooled) < OUTLIER for a, b in zip(n, k, strict=True)], dtype=bool)
        rate, strength = priors_without_own(n, k, ~stands)
        a, b = rate * strength + k, (1 - rate) * strength + n - k
        ends = [(stats.beta_quantile(0.025, x, y), stats.beta_quantile(0.975, x, y)) for x, y in zip(a, b, strict=True)]
        out = part[["kind", "group", "n", "k"]].assign(prior_rate=rate, prior_strength=strength, mean=a / (a + b), ci_low=[e[0] for e in ends], ci_high=[e[1] for e in ends], outlier=stands)
        out = out.sort_values(["ci_low", "mean", "group"], ascending=[False, False, True]).reset_index(drop=True)
        return out.assign(rank=(out.index + 1).astype("int32"))

    ranked = counts.groupBy("kind").applyInPandas(one, "kind string, group string, n long, k long, prior_rate double, prior_strength double, mean double, ci_low double, ci_high double, outlier boolean, rank int")
    disposition = contributor_disposition(F.col("ci_low"), F.col("prior_rate"), F.col("mean"), quarantine_mean)
    return ranked.select("kind", "group", "n", "k", "prior_rate", "prior_strength", "mean", "ci_low", "ci_high", "outlier", disposition.alias("disposition"), "rank")


def calibrate(findings: DataFrame, steps: DataFrame) -> DataFrame:
    """Replace scores by calibrated confidences. ``steps``: detector_id, edges (the upper end of each block of scores) and levels.

    A score belongs to the first block whose upper end isn't below it by more than 1e-12; scores above all belong to the last.
    Findings that didn't run keep what they have, if ``availability`` is told.
    """
    both = findings.join(steps, "detector_id", "left")
    at = F.least(F.size("levels"), 1 + F.size(F.filter("edges", lambda e: e <= F.col("score") - 1e-12)))
    known = F.col("edges").isNotNull()
    if "availability" in findings.columns:
        known = known & F.col("availability").isin("ran", "ok", "degraded")
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.element_at("levels", at)))
    return both.withColumn("__known", known).withColumn("confidence", F.when(F.col("__known"), level).otherwise(F.col("confidence"))).withColumn("calibrated", F.col("__known")).drop("__known", "edges", "levels")


def fit_calibration(records: DataFrame) -> DataFrame:
    """Isotonic steps by detector: the upper end and the level of each block. ``records``: detector_id, score, attacked. Equal scores are combined before they meet."""
    combined = records.groupBy("detector_id", "score").agg(F.count("*").alias("n"), F.sum(F.col("attacked").cast("double")).alias("k"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        for row in part.sort_values("score").itertuples():
            blocks.append([row.score, row.k, row.n])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                upper, k, n = blocks.pop()
                blocks[-1][0] = upper
                blocks[-1][1] += k
                blocks[-1][2] += n
        return pd.DataFrame({"detector_id": [part["detector_id"].iloc[0]], "edges": [[b[0] for b in blocks]], "levels": [[b[1] / b[2] for b in blocks]]})

    return combined.groupBy("detector_id").applyInPandas(one, "detector_id string, edges array<double>, levels array<double>")


def reliability(records: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and bins of predicted against observed. ``records``: detector_id, predicted, attacked."""
    b = F.least(F.floor(F.col("predicted") * bins), F.lit(bins - 1)).cast("int")
    y = F.col("attacked").cast("double")
    return records.withColumn("bin", b).groupBy("detector_id", "bin").agg(F.count("*").alias("n"), F.avg("predicted").alias("mean_predicted"), F.avg(y).alias("observed"), F.avg((F.col("predicted") - y) * (F.col("predicted") - y)).alias("brier"))


def combine_methods(findings: DataFrame, cap: float = 0.95) -> DataFrame:
    """Confidence that any method is right: 1 - prod(1 - c), capped."""
    return findings.groupBy("target_ref").agg(F.least(F.lit(cap), 1 - F.aggregate(F.sort_array(F.collect_list("confidence")), F.lit(1.0), lambda p, c: p * (1 - c))).alias("confidence"), F.count("*").alias("methods"))
