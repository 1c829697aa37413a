"""The verification walk of a whole ledger, without a task that reads all of it.

What a row can tell by itself or beside its neighbours are *facts*: whether it
parses, whether its signature holds under the key in effect, how its number
stands to those before it, whether it links to the row before, repeats a nonce,
or claims a root that the tree doesn't have. All facts are joins, windows inside
runs, and running values with carried totals.

What is left is cause and effect: a row that fails only because of an earlier
finding is counted as an effect of it. That needs a state, the last primary
finding and how far it reaches, and goes row by row, but only over rows with a
fact against them and only from one row to the next. Runs of positions are walked
side by side, first from each of the three states that they could be entered in
(none that reaches them, a changed record, another finding). These *transition
summaries* compose, so that summaries of runs give summaries of runs of runs, and
back down the state that each run is really entered in. A second walk from there
reports.

Rules, in this order for each row:

* unreadable records are reported and nothing else of them is judged;
* numbers: above the largest one so far by more than one, rows are missing
  (``record_delete``, with their count, unreadable ones between not counted) or all
  of the missing come later (``record_reorder``); a number that was there before is
  ``record_replay`` if the bytes are the same, ``ledger_fork`` if both are signed,
  else ``record_reorder``; a new number below the largest is an effect of the
  record that was put before it if that is a ``record_reorder``, else one itself;
* keys and signatures: ``key_unauthorised``; ``record_edit``, with directly
  following ones as its effects; records of a key whose rotation was refused are
  effects of that refusal;
* links: not to the row before is an effect of a finding at this row or the one
  before, else ``chain_broken``; at the first row it is ``genesis_mismatch``;
* for rows with a good signature: ``nonce_reuse`` inside an anchoring interval,
  wrong checkpoint roots and anchor events (effects of the first finding that
  changed bytes, if there is one, else ``checkpoint_mismatch``), ``model_swap`` for
  an inference without the registration that is in effect, refused rotations;
* ``clock_regression`` and ``degraded_gap`` are noted and are never a cause.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.operators import ledger as chain
from veristrata.operators import proofs
from veristrata.operators.running import beside, running
from veristrata.sources.session import cut, stored

#: A checked record. ``problem``: why it is unreadable, or null; ``sig``: ok, edit, key, refused (with ``refused_at``); ``link``: hash that the next row must name.
CHECKED = (
    "pos long, seq long, type string, problem string, sig string, refused_at long, prev string, link string, leaf string, nonce string, created string, "
    "tree_size long, root string, checkpoint_seq long, model_id string, weights string, pop boolean"
)
# Names of findings.
CAUSES = (
    "malformed_record", "non_canonical_encoding", "record_delete", "record_reorder", "record_replay", "record_edit", "ledger_fork", "key_unauthorised", "genesis_mismatch", "chain_broken", "nonce_reuse",
    "checkpoint_mismatch", "model_swap", "clock_regression", "degraded_gap",
)
#: Positions of a run, and runs of a run of runs.
WIDTH = 4096
FOUND = "pos long, cause string, n long, effects long"
FACTS = ("pos", "problem", "cause", "n", "owner", "sig", "refused_at", "genesis", "link_bad", "nonce_bad", "root_bad", "anchor_bad", "swap", "pop_bad", "clock", "gap", "taint_at", "taint")


# ---- facts ----


def _numbers(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``cause``, ``n`` and ``owner`` (position of the record put before it) from the records' own numbers.

    Only numbers are sent for all rows, and kept while the largest number so far is
    carried from run to run of positions; links are compared where a number repeats.
    """
    firsts = rows.where("seq is not null").groupBy("seq").agg(F.min("pos").alias("first_pos"))
    ranked = running(firsts, ["seq"], {"rank": ("sum", F.lit(1).cast("long"))})
    own = rows.select("pos", F.col("seq").alias("number"), F.col("problem").isNotNull().cast("long").alias("unread"), F.floor(F.col("pos") / width).alias("run"))
    both = stored(own.join(ranked.withColumnRenamed("seq", "number"), "number", "left"))
    # of equal numbers the first counts, before which the fewest rows are unreadable
    top = lambda bad: F.when(F.col("number").isNotNull(), F.struct(F.col("number").alias("seq"), "rank", (-F.col("pos")).alias("at"), bad.alias("bad")))
    no_bad = F.lit(0).cast("long")
    totals = both.groupBy("run").agg(F.sum("unread").alias("unread"), F.max(top(no_bad)).alias("top"), F.collect_list(F.when(F.col("unread") == 1, F.col("pos"))).alias("holes"))
    totals = totals.select("run", "unread", "top", F.size(F.filter("holes", lambda p: p < -F.col("top.at"))).cast("long").alias("inside"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("upto", F.coalesce(F.sum("unread").over(earlier), no_bad))
    raised = lambda t, by: F.when(t.isNotNull(), F.struct(t["seq"].alias("seq"), t["rank"].alias("rank"), t["at"].alias("at"), by.alias("bad")))
    handed = totals.select("run", "upto", F.max(raised(F.col("top"), F.col("upto") + F.col("inside"))).over(earlier).alias("carried"))
    inside = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("bad", F.coalesce(F.sum("unread").over(inside), no_bad)).withColumn("here", F.max(top(F.col("bad"))).over(inside)).join(handed, "run")
    before = seen.withColumn("bad", F.col("upto") + F.col("bad")).withColumn("top", F.greatest(raised(F.col("here"), F.col("upto") + F.col("here.bad")), F.col("carried")))
    m, r, b = (F.coalesce(F.col(f"top.{c}"), F.lit(v)) for c, v in (("seq", -1), ("rank", 0), ("bad", 0)))
    present, unreadable = F.col("rank") - r - 1, F.col("bad") - b
    absent = F.col("number") - m - 1 - present - unreadable
    again, behind = F.col("pos") > F.col("first_pos"), F.col("number") < m
    cause = F.when(again, F.lit("again")).when(behind, F.lit("behind")).when(absent > 0, "record_delete").when(present > 0, "record_reorder")
    odd = cut(before.select("pos", "number", "first_pos", cause.alias("cause"), F.when(~again & ~behind & (absent > 0), absent).alias("n")).where("cause is not null"))
    # repeats: each beside the first record of its number
    pairs = odd.where("cause = 'again'").select("pos", "first_pos")
    asked = beside(pairs.select(F.explode(F.array("pos", "first_pos")).alias("pos")).distinct())
    held = cut(rows.select("pos", chain.packed(F.col("link")).alias("link"), "sig").join(asked, "pos"))
    first = held.select(F.col("pos").alias("first_pos"), F.col("link").alias("first_link"), F.col("sig").alias("first_sig"))
    repeat = F.when(F.col("link") == F.col("first_link"), "record_replay").when((F.col("sig") == "ok") & (F.col("first_sig") == "ok"), "ledger_fork").otherwise("record_reorder")
    none = F.lit(None).cast("long")
    repeats = pairs.join(held, "pos").join(first, "first_pos").select("pos", repeat.alias("cause"), none.alias("n"), none.alias("owner"))
    # a record that is behind belongs to the first one that went past its number
    past = running(odd.where("cause <> 'again'"), ["number"], {"next": ("min", F.when(F.col("cause") != "behind", F.col("pos") * 2 + F.when(F.col("cause") == "record_reorder", 1).otherwise(0)))}, backward=True)
    owned = F.col("next").isNotNull() & (F.col("next") % 2 == 1)
    settled = past.select("pos", F.when(F.col("cause") != "behind", F.col("cause")).when(~owned | F.col("next").isNull(), "record_reorder").alias("cause"), "n", F.when((F.col("cause") == "behind") & owned, F.floor(F.col("next") / 2)).alias("owner"))
    return settled.unionByName(repeats)


def _nonces(rows: DataFrame) -> DataFrame:
    """Positions whose nonce was used before inside the anchoring interval. An anchor's own nonce counts in the interval that it closes and in the one that it opens."""
    signed = rows.where("sig = 'ok' and problem is null")
    found = chain.count_before(signed.select(F.col("pos").alias("seq"), "nonce", "type"), F.col("type") == "anchor_event", "interval").withColumn("own", F.lit(True))
    opened = found.where("type = 'anchor_event'").withColumn("interval", F.col("interval") + 1).withColumn("own", F.lit(False))
    use = F.row_number().over(Window.partitionBy("interval", "nonce").orderBy("seq"))
    return found.unionByName(opened).withColumn("use", use).where("use > 1 and own").select(F.col("seq").alias("pos"), F.lit(True).alias("nonce_bad"))


def _roots(rows: DataFrame, size: int) -> DataFrame:
    """``root_bad`` of checkpoints and ``anchor_bad`` of anchor events."""
    signed = rows.where("sig = 'ok' and problem is null")
    claims = signed.where("type = 'checkpoint'").select("pos", "seq", "tree_size", "root")
    leaves = rows.select(F.col("pos").alias("idx"), F.col("leaf").alias("hash"))
    known = proofs.roots_of_prefixes(leaves, size, claims.select(F.col("pos").alias("tree_size"))).select(F.col("tree_size").alias("pos"), F.col("root").alias("true_root"))
    judged = cut(claims.join(known, "pos", "left").withColumn("good", (F.col("tree_size") == F.col("pos")) & F.col("root").eqNullSafe(F.col("true_root"))))
    good = judged.where("good").select(F.col("seq").alias("checkpoint_seq"), "tree_size", "root", F.col("pos").alias("at"))
    events = signed.where("type = 'anchor_event'").select("pos", "checkpoint_seq", "tree_size", "root")
    a, g = events.alias("a"), good.alias("g")
    seen = a.join(g, (F.col("a.checkpoint_seq") == F.col("g.checkpoint_seq")) & (F.col("a.tree_size") == F.col("g.tree_size")) & (F.col("a.root") == F.col("g.root")) & (F.col("g.at") < F.col("a.pos")), "left_anti")
    no = F.lit(None).cast("boolean")
    return judged.where("not good").select("pos", F.lit(True).alias("root_bad"), no.alias("anchor_bad")).unionByName(seen.select(F.col("a.pos").alias("pos"), no.alias("root_bad"), F.lit(True).alias("anchor_bad")))


def _swaps(rows: DataFrame) -> DataFrame:
    """Inferences whose model isn't the one registered last under its id."""
    signed = rows.where("sig = 'ok' and problem is null and model_id is not null").select(F.col("pos").alias("seq"), "type", "model_id", "weights")
    found = chain.in_effect(signed, "model_id", F.col("type") == "model_registration", "weights")
    return found.where((F.col("type") == "inference") & ~F.col("in_effect").eqNullSafe(F.col("weights"))).select(F.col("seq").alias("pos"), F.lit(True).alias("swap"))


def facts(checked: DataFrame, genesis: str = chain.ZERO) -> DataFrame:
    """Rows with a fact against them. ``checked``: CHECKED, ``pos`` from 0 without gaps, read several times (store it); ``genesis``: what the first record must name."""
    rows = checked
    size = rows.count()
    prev, link = chain.packed(F.col("prev")), chain.packed(F.when(F.col("problem").isNull(), F.col("link")))
    both = chain.in_order(rows.select("pos", F.col("pos").alias("seq"), "type", "problem", "sig", "refused_at", prev.alias("prev"), link.alias("link"), "pop"), {"expected": "link"}).drop("seq")
    clock = chain.in_order(rows.where("problem is null").select(F.col("pos").alias("seq"), "created"), {"created_before": "created"}).where("created < created_before").select(F.col("seq").alias("pos"), F.lit(True).alias("clock"))
    first = F.col("pos") == 0
    own = both.select(
        "pos", "problem", F.when(F.col("problem").isNull(), F.col("sig")).alias("sig"), "refused_at",
        (first & (F.col("type") != "genesis")).alias("genesis"),
        F.when(F.col("problem").isNull(), ~F.coalesce(F.col("prev") == F.when(first, chain.packed(F.lit(genesis))).otherwise(F.col("expected")), F.lit(False))).alias("link_bad"),
        ((F.col("type") == "key_rotation") & (F.col("sig") == "ok") & ~F.coalesce("pop", F.lit(False))).alias("pop_bad"),
        ((F.col("type") == "degraded_marker") & (F.col("sig") == "ok")).alias("gap"),
    )
    odd = own.where("problem is not null or sig <> 'ok' or genesis or link_bad or pop_bad or gap")
    out = odd.drop("problem", "sig")
    for more in (_numbers(rows), _nonces(rows), _roots(rows, size), _swaps(rows), clock):
        out = out.unionByName(more, allowMissingColumns=True)
    # each table has a row a position at most, so the maximum is the one value that isn't null
    out = out.groupBy("pos").agg(*(F.max(c).alias(c) for c in out.columns if c != "pos"))
    out = out.join(rows.select("pos", "problem", F.when(F.col("problem").isNull(), F.col("sig")).alias("sig")), "pos")
    changed = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("cause").isNotNull(), F.col("cause")).when(F.col("sig") == "edit", "record_edit").when((F.col("sig") == "key") | F.col("pop_bad"), "key_unauthorised")
    out = cut(out.withColumn("__changed", changed))
    taint = out.where("__changed is not null").agg(F.min(F.struct("pos", "__changed")).alias("t")).first()["t"]
    at, what = (taint["pos"], taint["__changed"]) if taint else (None, None)
    return out.withColumn("taint_at", F.lit(at).cast("long")).withColumn("taint", F.lit(what).cast("string")).select(*FACTS)


# ---- cause and effect ----

#: Owner that stands for the finding a run is entered with.
ENTERED = -1


@dataclass(frozen=True)
class Open:
    """The last primary finding and the last position that it reaches."""

    pos: int
    cause: str
    until: int


def step(state: Open | None, row: dict) -> tuple[list[tuple[int, str, int | None, int]], Open | None]:
    """One row's findings (pos, cause, n, 0) and effects (owner's pos and cause, None, 1), and the state after it."""
    p, out = row["pos"], []

    def primary(cause: str, n: int | None = None) -> None:
        nonlocal state
        out.append((p, cause, n, 0))
        state = Open(p, cause, p)

    def effect_of(pos: int, cause: str, reaches: bool) -> None:
        nonlocal state
        out.append((pos, cause, None, 1))
        if reaches:
            state = Open(pos, cause, p)

    if row["problem"] is not None:
        primary(row["problem"])
        return out, state
    if row["cause"] is not None:
        primary(row["cause"], row["n"])
    elif row["owner"] is not None:
        effect_of(row["owner"], "record_reorder", True)
    if row["genesis"]:
        primary("genesis_mismatch")
    if row["sig"] == "refused":
        effect_of(row["refused_at"], "key_unauthorised", True)
    elif row["sig"] == "key":
        primary("key_unauthorised")
    elif row["sig"] == "edit":
        if state is not None and state.cause == "record_edit" and state.until == p - 1:
            effect_of(state.pos, "record_edit", True)
        else:
            primary("record_edit")
    if row["link_bad"]:
        if p == 0:
            primary("genesis_mismatch")
        elif state is not None and state.until >= p - 1:
            effect_of(state.pos, state.cause, False)
        else:
            primary("chain_broken")
    if row["sig"] == "ok":
        tainted = row["taint_at"] is not None and row["taint_at"] <= p
        if row["nonce_bad"] and row["cause"] != "record_replay":  # a copy repeats its nonce
            primary("nonce_reuse")
        if row["root_bad"] and tainted or row["anchor_bad"] and tainted:
            effect_of(row["taint_at"], row["taint"], False)
        elif row["root_bad"]:
            primary("checkpoint_mismatch")
        elif row["anchor_bad"]:
            out.append((p, "checkpoint_mismatch", None, 0))
        if row["swap"]:
            primary("model_swap")
        if row["pop_bad"]:
            primary("key_unauthorised")
        if row["gap"]:
            out.append((p, "degraded_gap", None, 0))
    if row["clock"]:
        out.append((p, "clock_regression", None, 0))
    return out, state


def _rows(run: pd.DataFrame) -> list[dict]:
    run = run.sort_values("pos")
    return [{k: None if v is None or v != v else int(v) if k in ("pos", "n", "owner", "refused_at", "taint_at") else v for k, v in zip(FACTS, row, strict=True)} for row in run[list(FACTS)].astype(object).where(run[list(FACTS)].notna(), None).itertuples(index=False)]


def _leaves(state: Open | None, last: int) -> Open | None:
    """A finding that doesn't reach a run's end can't reach the next."""
    return state if state is not None and state.until >= last else None


#: The states that a run can be entered in, as far as they matter.
WAYS = ("none", "record_edit", "other")


def _way(state: Open | None) -> str:
    return "none" if state is None else "record_edit" if state.cause == "record_edit" else "other"


def _entered(way: str, start: int) -> Open | None:
    return None if way == "none" else Open(ENTERED, way, start - 1)


SUMMARY = "run long, way string, owner long, cause string"


def _summarise(rows: list[dict], run: int, width: int) -> list[tuple]:
    """How the run is left, for each way in: (run, way, owner, cause); a null owner is no finding that reaches on."""
    out = []
    for way in WAYS:
        state = _entered(way, run * width)
        for row in rows:
            state = step(state, row)[1]
        state = _leaves(state, (run + 1) * width - 1)
        out.append((run, way, state.pos if state else None, state.cause if state else None))
    return out


def _table(summaries: pd.DataFrame) -> dict[int, dict[str, tuple[int | None, str | None]]]:
    out: dict[int, dict] = {}
    for r in summaries.itertuples(index=False):
        out.setdefault(int(r.run), {})[r.way] = (None if pd.isna(r.owner) else int(r.owner), r.cause if isinstance(r.cause, str) else None)
    return out


def _through(of: dict[str, tuple], owner: int | None, cause: str | None) -> tuple[int | None, str | None]:
    """Out of a run that is entered with a finding. What is left of the entered one keeps its own name."""
    way = "none" if owner is None else "record_edit" if cause == "record_edit" else "other"
    left, name = of[way]
    return (owner, cause) if left == ENTERED else (left, name)


def _compose(summaries: pd.DataFrame, upper: int, width: int) -> list[tuple]:
    """The summary of a run of runs. Runs without rows are left by nothing that reaches on."""
    of = _table(summaries)
    out = []
    for way in WAYS:
        owner, cause, at = (None, None, upper * width - 1) if way == "none" else (ENTERED, way, upper * width - 1)
        for run in sorted(of):
            owner, cause = _through(of[run], *((owner, cause) if run == at + 1 else (None, None)))
            at = run
        if at != (upper + 1) * width - 1:
            owner, cause = None, None
        out.append((upper, way, owner, cause))
    return out


def _descend(summaries: pd.DataFrame, start: int, owner: int | None, cause: str | None) -> list[tuple]:
    """(run, owner, cause) that each run is entered with, given what the first one, ``start``, is."""
    of, at, out = _table(summaries), start - 1, []
    for run in sorted(of):
        owner, cause = (owner, cause) if run == at + 1 else (None, None)
        out.append((run, owner, cause))
        owner, cause = _through(of[run], owner, cause)
        at = run
    return out


def cause_and_effect(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """``pos``, ``cause``, ``n`` (of missing records) and ``effects`` of every finding. ``found``: those of ``facts``."""
    dealt = found.withColumn("run", F.floor(F.col("pos") / width))

    def summarise(key, run):
        return pd.DataFrame(_summarise(_rows(run), int(key[0]), width), columns=["run", "way", "owner", "cause"]).astype({"owner": "Int64"})

    levels = [cut(dealt.groupBy("run").applyInPandas(summarise, SUMMARY))]

    def compose(key, runs):
        return pd.DataFrame(_compose(runs, int(key[0]), width), columns=["run", "way", "owner", "cause"]).astype({"owner": "Int64"})

    while levels[-1].agg(F.max("run")).first()[0] or 0:  # a level for each factor of ``width`` runs
        levels.append(cut(levels[-1].withColumn("upper", F.floor(F.col("run") / width)).groupBy("upper").applyInPandas(compose, SUMMARY)))

    ins = "run long, in_owner long, in_cause string"
    entered = levels[-1].sparkSession.createDataFrame([(0, None, None)], ins)

    def descend(key, runs, above):
        if not len(runs):
            return pd.DataFrame({"run": [], "in_owner": [], "in_cause": []}).astype({"run": "int64", "in_owner": "Int64", "in_cause": object})
        first = above.iloc[0] if len(above) else None
        owner = None if first is None or pd.isna(first["in_owner"]) else int(first["in_owner"])
        rows = _descend(runs, int(key[0]) * width, owner, first["in_cause"] if owner is not None else None)
        return pd.DataFrame(rows, columns=["run", "in_owner", "in_cause"]).astype({"in_owner": "Int64"})

    for below in reversed(levels[:-1]):
        upper = below.withColumn("upper", F.floor(F.col("run") / width))
        entered = upper.groupBy("upper").cogroup(entered.withColumnRenamed("run", "upper").groupBy("upper")).applyInPandas(descend, ins)

    def report(key, run):
        owner = run["in_owner"].iloc[0]
        state = None if pd.isna(owner) else Open(int(owner), run["in_cause"].iloc[0], int(key[0]) * width - 1)
        out: list[tuple] = []
        for row in _rows(run):
            more, state = step(state, row)
            out += more
        return pd.DataFrame(out, columns=["pos", "cause", "n", "effects"]).astype({"n": "Int64"})

    events = dealt.join(entered, "run", "left").groupBy("run").applyInPandas(report, FOUND)
    return events.groupBy("pos", "cause").agg(F.max("n").alias("n"), F.sum("effects").alias("effects"))


def walk(checked: DataFrame, genesis: str = chain.ZERO, width: int = WIDTH) -> DataFrame:
    """Findings of a whole ledger: ``pos``, ``seq`` (null if unreadable), ``cause``, ``n``, ``effects``; empty if it is sound."""
    rows = stored(checked)
    found = cause_and_effect(facts(rows, genesis), width)
    return found.join(rows.select("pos", "seq"), "pos").select("pos", "seq", "cause", "n", "effects")


def walk_all(rows: Iterable[dict]) -> list[tuple[int, str, int | None, int]]:
    """The same of a list of facts in order, one after another: for few rows."""
    state, found = None, {}
    for row in rows:
        more, state = step(state, row)
        for pos, cause, n, effects in more:
            old = found.get((pos, cause), (None, 0))
            found[pos, cause] = (n if n is not None else old[0], old[1] + effects)
    return sorted((p, c, n, e) for (p, c), (n, e) in found.items())


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def as_checked(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of CHECKED, nulls for those that it lacks."""
    return rows.select(*(column_or_null(rows, *c.split()) for c in CHECKED.split(", ")))
