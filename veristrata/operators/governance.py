"""Reading and deciding: finding index, event folds, timelines, seals and coverage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators.risk import DISPOSITIONS, SEVERITIES, rank_of, verdict
from veristrata.operators.running import running

# Actions of the workflow and codes of its checks.
ACTIONS = ("assign", "acknowledge", "override", "approve", "quarantine", "release")
REASON_CODES = ("quality_issue", "known_benign", "insufficient_evidence", "accepted_risk", "superseded_by_rescan", "other_with_justification")
#: Of findings on provenance only these may be given, and the last one is marked for audit.
PROV_REASON_CODES = ("known_restore", "test_data", "superseded_ledger", "false_positive_confirmed")


def page_of_findings(findings: DataFrame, limit: int = 50, offset: int = 0, disposition: str | None = None, nature: str | None = None, availability: str | None = None, module: str | None = None) -> DataFrame:
    """Filter, order by severity (gravest first), confidence, id, and cut one page."""
    for name, value in (("disposition", disposition), ("nature", nature), ("availability", availability)):
        if value is not None:
            findings = findings.where(F.col(name) == value)
    if module is not None:
        findings = findings.where(F.col("detector_id").startswith(module + "."))
    return findings.orderBy(rank_of(F.col("severity"), SEVERITIES).desc(), F.col("confidence").desc(), "finding_id").offset(offset).limit(limit)


def scans_newest_first(scans: DataFrame) -> DataFrame:
    """All scans with their ``place`` in the list, the newest first; equal times by the larger id."""
    return running(scans, ["created_at", "scan_id"], {"place": ("sum", F.lit(1).cast("long"))}, backward=True)


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """All findings with their ``place``: by severity (gravest first), confidence and id. For one page alone see ``page_of_findings``."""
    keyed = findings.withColumn("__grave", -rank_of(F.col("severity"), SEVERITIES)).withColumn("__sure", -F.col("confidence"))
    return running(keyed, ["__grave", "__sure", "finding_id"], {"place": ("sum", F.lit(1).cast("long"))}).drop("__grave", "__sure")


def qualified_verdict(findings: DataFrame) -> DataFrame:
    """One line a scan: its verdict, and how much of it was assessed. A verdict without its coverage would say too much."""
    of = lambda v: F.count_if(F.col("availability") == v)
    counts = findings.groupBy("scan_id").agg(F.count("*").alias("n"), of("ran").alias("ran"), of("error").alias("crashed"), of("unavailable").alias("not_assessed"))
    line = F.format_string("%s (%d of %d assessed; %d crashed; %d not assessed)", "verdict", "ran", "n", "crashed", "not_assessed")
    return verdict(findings).join(counts, "scan_id").select("scan_id", "ran", "crashed", "not_assessed", F.when(F.col("ran") == F.col("n"), F.concat("verdict", F.lit(" (all assessed)"))).otherwise(line).alias("line"))


def seal_check(scans: DataFrame, records: DataFrame) -> DataFrame:
    """``seal``: does the last sealed hash of a scan equal that of its file? ``scans``: scan_id, file_sha256; ``records``: seq, scan_id, report_sha256."""
    last = records.groupBy("scan_id").agg(F.max_by("report_sha256", "seq").alias("sealed"), F.max("seq").alias("sealed_at"))
    return scans.join(last, "scan_id", "left").withColumn("seal", F.when(F.col("sealed").isNull(), "unsealed").when(F.col("sealed") == F.col("file_sha256"), "match").otherwise("mismatch"))


def coverage_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attack classes assessed by one side or both. Each: attack_class, reason (null if assessed)."""
    a = left.groupBy("attack_class").agg(F.bool_or(F.col("reason").isNull()).alias("l"), F.max("reason").alias("reason_l"))
    b = right.groupBy("attack_class").agg(F.bool_or(F.col("reason").isNull()).alias("r"), F.max("reason").alias("reason_r"))
    both = a.join(b, "attack_class", "full_outer")
    l, r = F.coalesce("l", F.lit(False)), F.coalesce("r", F.lit(False))
    return both.select("attack_class", F.when(l & r, "both").when(l, "only_left").when(r, "only_right").otherwise("neither").alias("side"), F.when(l & ~r, F.coalesce("reason_r", F.lit("absent"))).alias("lost_reason"))


def coverage_matrix(checks: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """For each attack class: checks that assessed it and that didn't; classes no check names are ``never covered``. ``checks``: detector_id, attack_classes, ran."""
    each = checks.select("detector_id", "ran", F.explode("attack_classes").alias("attack_class"))
    g = each.groupBy("attack_class").agg(F.array_sort(F.collect_set(F.when(F.col("ran"), F.col("detector_id")))).alias("assessed"), F.array_sort(F.collect_set(F.when(~F.col("ran"), F.col("detector_id")))).alias("not_assessed"))
    out = taxonomy.select("attack_class").join(g, "attack_class", "left")
    state = F.when(F.col("assessed").isNull(), "never covered").when(F.size("assessed") > 0, "assessed").otherwise("not assessed")
    return out.withColumn("state", state)


def timeline(events: DataFrame) -> DataFrame:
    """Readable lines of a ledger, in order."""
    line = (
        F.when(F.col("type") == "analyst_event", F.concat("actor_id", F.lit(" "), "action", F.lit(" "), "target_ref"))
        .when(F.col("type") == "scan_record", F.concat(F.lit("scan "), "target_ref", F.lit(" sealed")))
        .otherwise(F.replace("type", F.lit("_"), F.lit(" ")))
    )
    return events.select("seq", "type", line.alias("line")).orderBy("seq")


def once(events: DataFrame) -> DataFrame:
    """The first row of every request: an appended request is not appended again."""
    first = events.groupBy("request_id").agg(F.min("seq").alias("seq"))
    return events.join(first, ["request_id", "seq"])


def error_code(least_text: int = 10) -> Column:
    """Null for a valid request, else the first rule it breaks. Findings of ``prov.*`` detectors have reason codes of their own."""
    allowed = F.when(F.col("detector_id").startswith("prov."), F.col("reason_code").isin(*PROV_REASON_CODES)).otherwise(F.col("reason_code").isin(*REASON_CODES))
    return (
        F.when(~F.col("action").isin(*ACTIONS), "unknown_action")
        .when(~F.coalesce(F.col("request_id").rlike("^[0-9a-f]{8,64}$"), F.lit(False)), "bad_request_id")
        .when(F.col("action").isin("override", "release") & (F.length(F.trim(F.coalesce("justification", F.lit("")))) < least_text), "justification_too_short")
        .when((F.col("action") == "override") & ~F.coalesce(allowed, F.lit(False)), "unknown_reason_code")
        .when((F.col("action") == "assign") & F.col("assignee").isNull(), "no_assignee")
    )


def audit_flagged() -> Column:
    """Is an event's reason one that is allowed, but shown to auditors?"""
    return F.col("reason_code") == PROV_REASON_CODES[-1]


# ---- fold of analyst events into the states of findings and of targets ----

STATE = "finding_id string, original string, disposition string, assignee string, acknowledged_by array<string>, pending_disposition string, pending_by string, pending_seq long, superseded array<bigint>, cited_seq long, last_seq long"
TARGET = "target_type string, target_ref string, status string, pending_by string, pending_seq long, cited_seq long, last_seq long"
#: Actions on a target (a sample, contributor, batch or model) rather than on a finding.
ON_TARGETS = ("quarantine", "release")
_RANKS = {name: rank for rank, name in enumerate(DISPOSITIONS)}
_SETTLED = {"pending_disposition": None, "pending_by": None, "pending_seq": None}


def new_state(finding_id: str, disposition: str) -> dict:
    return {"finding_id": finding_id, "original": disposition, "disposition": disposition, "assignee": None, "acknowledged_by": [], **_SETTLED, "superseded": [], "cited_seq": None, "last_seq": -1}


def new_target(target_type: str, target_ref: str) -> dict:
    return {"target_type": target_type, "target_ref": target_ref, "status": "active", "pending_by": None, "pending_seq": None, "cited_seq": None, "last_seq": -1}


def approves(state: dict, event: dict) -> bool:
    """Does an approval name the change that waits, and come from another person than asked for it?"""
    return state["pending_seq"] is not None and event.get("refs_seq") == state["pending_seq"] and event["actor_id"] != state["pending_by"]


def step(state: dict, event: dict) -> dict:
    """One event on a finding. A ledger's event is a fact: it is never rejected here, and moves ``last_seq`` even where it changes nothing.

    Raising a disposition takes effect at once and ends what waits; lowering it
    waits until a second person approves it by its ``seq``, and takes the place
    of what waited before.
    """
    seq, actor, action = int(event["seq"]), event["actor_id"], event["action"]
    s = state | {"last_seq": max(state["last_seq"], seq)}
    if action == "assign":
        return s | {"assignee": event.get("assignee")}
    if action == "acknowledge":
        return s if actor in s["acknowledged_by"] else s | {"acknowledged_by": [*s["acknowledged_by"], actor]}
    if action == "override":
        new = event.get("new_disposition") or s["disposition"]
        if _RANKS.get(new, 0) > _RANKS.get(s["disposition"], 0):
            return s | {"disposition": new, "cited_seq": seq} | _SETTLED
        waiting = [] if s["pending_seq"] is None else [s["pending_seq"]]
        return s | {"superseded": [*s["superseded"], *waiting], "pending_disposition": new, "pending_by": actor, "pending_seq": seq}
    if action == "approve" and approves(s, event):
        return s | {"disposition": s["pending_disposition"], "cited_seq": seq} | _SETTLED
    return s


def target_step(state: dict, event: dict) -> dict:
    """One event on a target: quarantine at once, release when a second person approves it by its ``seq``."""
    seq, action = int(event["seq"]), event["action"]
    s = state | {"last_seq": max(state["last_seq"], seq)}
    if action == "quarantine":
        return s | {"status": "quarantined", "cited_seq": seq, "pending_by": None, "pending_seq": None}
    if action == "release":
        return s | {"pending_by": event["actor_id"], "pending_seq": seq}
    if action == "approve" and approves(s, event):
        return s | {"status": "active", "cited_seq": seq, "pending_by": None, "pending_seq": None}
    return s


def on_targets(events: DataFrame) -> DataFrame:
    """Events with ``on_target``: quarantines, releases, and approvals of an earlier release."""
    releases = events.where(F.col("action") == "release").select(F.col("seq").alias("__release")).distinct()
    named = (F.col("action") == "approve") & (F.col("refs_seq") == F.col("__release")) & (F.col("__release") < F.col("seq"))
    return events.join(releases, named, "left").withColumn("on_target", F.col("action").isin(*ON_TARGETS) | F.col("__release").isNotNull()).drop("__release")


def _plain(events: pd.DataFrame) -> list[dict]:
    return [{k: None if v is None or v != v else v for k, v in r.items()} for r in events.astype(object).to_dict("records")]


def _records(events: pd.DataFrame) -> list[dict]:
    return _plain(events.sort_values("seq"))


def fold(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Each finding's state after its events, in the order of ``seq``. ``findings``: finding_id, disposition. ``events``: seq, finding_id, actor_id, action, refs_seq, new_disposition, assignee.

    Rows come to a task in order, findings before their events, and pass through it:
    it holds a batch and one finding's state, however many events a finding has.
    """
    told = on_targets(events).where("not on_target").drop("on_target")
    known = findings.select("finding_id", F.col("disposition").alias("__given"), F.lit(True).alias("__known"))
    both = known.unionByName(told.withColumn("__known", F.lit(False)), allowMissingColumns=True)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, states = None, []
        for batch in batches:
            out: list[dict] = []
            for row in _plain(batch):
                first, given = row.pop("__known"), row.pop("__given")
                if row["finding_id"] != at:
                    out += states
                    at, states = row["finding_id"], []
                states = [*states, new_state(at, given)] if first else [step(s, row) for s in states]
            yield _frame(out, STATE)
        yield _frame(states, STATE)

    return both.repartition("finding_id").sortWithinPartitions("finding_id", F.desc("__known"), "seq").mapInPandas(run, STATE)


def fold_targets(events: DataFrame) -> DataFrame:
    """The state of every target that an event quarantines, releases, or approves the release of. ``events``: as for ``fold``, with target_type and target_ref. Rows pass through a task as there."""
    told = on_targets(events).where("on_target").drop("on_target")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            out: list[dict] = []
            for event in _plain(batch):
                key = (event["target_type"], event["target_ref"])
                if key != at:
                    out += [] if state is None else [state]
                    at, state = key, new_target(*key)
                state = target_step(state, event)
            yield _frame(out, TARGET)
        yield _frame([] if state is None else [state], TARGET)

    return told.repartition("target_type", "target_ref").sortWithinPartitions("target_type", "target_ref", "seq").mapInPandas(run, TARGET)


def _frame(states: list[dict], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(states, columns=names)
    return out.astype({c.split()[0]: "Int64" for c in schema.split(", ") if c.endswith(" long")})


def orphans(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Events of findings that aren't there."""
    return events.join(findings.select("finding_id"), "finding_id", "left_anti")


def effective_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("disposition").agg(F.count("*").alias("n"), F.count("pending_disposition").alias("pending"))


def admissible(state: dict, event: dict, least_text: int = 10) -> str | None:
    """Why an event can't be appended to a finding in this state; None if it can."""
    if event.get("expected_prev_seq") is not None and event["expected_prev_seq"] != state["last_seq"]:
        return "stale"
    if event["action"] == "approve" and not approves(state, event):
        return "same_person" if event.get("refs_seq") == state["pending_seq"] and state["pending_seq"] is not None else "nothing_to_approve"
    if event["action"] in ("override", "release") and len((event.get("justification") or "").strip()) < least_text:
        return "justification_too_short"
    return None


def fold_all(state: dict, events: Iterable[dict]) -> dict:
    for e in events:
        state = step(state, e)
    return state
