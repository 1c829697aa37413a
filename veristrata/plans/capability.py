"""Plan before run: what a set of inputs allows, which checks run, and what each produces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one output type of every check.
FINDING = (
    "finding_id string, scan_id string, detector_id string, detector_version string, target_type string, target_ref string, severity string, confidence double, score_raw double, threshold double, "
    "reason string, attack_class string, evidence array<struct<kind:string,caption:string,path:string,data:string>>, access_assumptions array<string>, limitations array<string>, "
    "disposition string, disposition_rule string, produced_by string, nature string, exclusion_reason string, availability string"
)
TIERS = ("triage", "standard", "deep", "forensic")


@dataclass(frozen=True)
class Check:
    """A plug-in: ``run(context) -> DataFrame`` of findings."""

    detector_id: str
    version: str
    requires: frozenset[str]
    optional: frozenset[str]
    attack_classes: tuple[str, ...]
    run: Callable[[dict], DataFrame]
    tier: str = "triage"
    parameters: frozenset[str] = frozenset()


@dataclass
class Registry:
    """Checks by id. Undeclared attack classes and repeated ids are errors at start."""

    taxonomy: dict[str, str]
    checks: dict[str, Check] = field(default_factory=dict)

    def add(self, check: Check) -> Check:
        if check.detector_id in self.checks:
            raise ValueError(f"{check.detector_id} is registered already")
        if unknown := set(check.attack_classes) - set(self.taxonomy):
            raise ValueError(f"{check.detector_id} names unknown attack classes: {sorted(unknown)}")
        self.checks[check.detector_id] = check
        return check


def check_parameters(check: Check, given: dict) -> None:
    if unknown := set(given) - check.parameters:
        raise ValueError(f"{check.detector_id} has no parameters {sorted(unknown)}")


def resolve(check: Check, capabilities: set[str]) -> tuple[str, list[str]]:
    """(availability, what is missing): unavailable without a required capability, degraded without an optional one."""
    if missing := sorted(check.requires - capabilities):
        return "unavailable", missing
    if missing := sorted(check.optional - capabilities):
        return "degraded", missing
    return "ok", []


def build_plan(registry: Registry, capabilities: set[str], tier: str = "standard", disabled: set[str] | None = None, rows: int | None = None, rate: float | None = None) -> list[dict]:
    """One row a check, made before any of them runs. A missing capability outweighs the budget as reason."""
    disabled = disabled or set()
    if unknown := disabled - registry.checks.keys():
        raise ValueError(f"unknown checks: {sorted(unknown)}")
    out = []
    for name in sorted(registry.checks):
        c = registry.checks[name]
        state, missing = resolve(c, capabilities)
        if name in disabled:
            decision, reason = "excluded", "disabled"
        elif state == "unavailable":
            decision, reason = "excluded", "missing: " + ", ".join(missing)
        elif TIERS.index(c.tier) > TIERS.index(tier):
            decision, reason = "excluded", f"needs tier {c.tier}"
        else:
            decision, reason = "run", "without: " + ", ".join(missing) if missing else ""
        seconds = rows / rate if rows and rate else None
        out.append({"detector_id": name, "decision": decision, "availability": state, "reason": reason, "estimate_s": seconds})
    return out


def resolve_table(checks: DataFrame, capabilities: list[str]) -> DataFrame:
    """The same resolution as columns. ``checks``: detector_id, requires, optional (arrays)."""
    have = F.array(*(F.lit(c) for c in capabilities)) if capabilities else F.array().cast("array<string>")
    need, want = F.array_sort(F.array_except("requires", have)), F.array_sort(F.array_except("optional", have))
    state = F.when(F.size(need) > 0, "unavailable").when(F.size(want) > 0, "degraded").otherwise("ok")
    return checks.select("detector_id", state.alias("availability"), F.array_join(F.when(F.size(need) > 0, need).otherwise(want), ",").alias("missing"))


def execute(spark: SparkSession, registry: Registry, plan: list[dict], context: dict, path: str) -> DataFrame:
    """Run the plan; each check is written by itself, so that one that fails becomes a finding and the others stay."""
    parts = []
    for row in plan:
        target = f"{path}/{row['detector_id']}"
        if row["decision"] == "run":
            try:
                registry.checks[row["detector_id"]].run(context).write.mode("overwrite").parquet(target)
                parts.append(spark.read.schema(FINDING).parquet(target).withColumn("availability", F.coalesce("availability", F.lit("ran"))))
                continue
            except Exception as error:  # noqa: BLE001  a check's failure is a result
                row = row | {"availability": "error", "reason": f"{type(error).__name__}: {str(error)[:200]}"}
        parts.append(status_finding(spark, context.get("scan_id", ""), row))
    out = spark.createDataFrame([], FINDING)
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def status_finding(spark: SparkSession, scan_id: str, row: dict) -> DataFrame:
    """A check that didn't run still says so."""
    base = spark.createDataFrame([(scan_id, row["detector_id"], row["availability"] if row["availability"] != "ok" else "excluded", row["reason"])], "scan_id string, detector_id string, availability string, reason string")
    named = base.withColumn("severity", F.lit("info")).withColumn("target_type", F.lit("scan")).withColumn("target_ref", F.col("scan_id")).withColumn("attack_class", F.lit("operational")).withColumn("exclusion_reason", F.col("reason"))
    return named.withColumn("finding_id", finding_id(F.col("detector_id"), F.col("target_type"), F.col("target_ref"), F.col("attack_class"), F.col("reason")))


def finding_id(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts, joined by the unit separator."""
    return F.left(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), F.lit(16))
