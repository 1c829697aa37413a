"""The parallel verification walk against a plain sequential one, on ledgers with random damage."""

import hashlib
import random

import pytest

from tests.test_ledger import reference_root
from veristrata.operators import ledger, walk

COLUMNS = [c.split()[0] for c in walk.CHECKED.split(", ")]


def sha(x):
    return hashlib.sha256(repr(x).encode()).hexdigest()


def sound(n, rng):
    """``n`` records with checkpoints, anchors, registrations and inferences."""
    rows = []
    for i in range(n):
        kind = "genesis" if i == 0 else "checkpoint" if i % 11 == 10 else "anchor_event" if i % 11 == 0 else "model_registration" if i % 13 == 1 else "degraded_marker" if i % 37 == 5 else "inference"
        row = dict.fromkeys(COLUMNS) | {"pos": i, "seq": i, "type": kind, "sig": "ok", "prev": rows[-1]["link"] if rows else ledger.ZERO, "nonce": f"n{i}", "created": f"{i:06d}", "link": sha(("link", i, rng.random())), "leaf": sha(("leaf", i))}
        if kind == "checkpoint":
            row |= {"tree_size": i, "root": reference_root([bytes.fromhex(r["leaf"]) for r in rows]).hex()}
        if kind == "anchor_event":
            row |= {"checkpoint_seq": i - 1, "tree_size": rows[-1]["tree_size"], "root": rows[-1]["root"]}
        if kind in ("model_registration", "inference"):
            row |= {"model_id": f"m{i % 2}" if i > 14 else "m1", "weights": "w"}
        if kind == "model_registration" and i == 14:
            row["model_id"] = "m0"
        rows.append(row)
    return rows


def damaged(rows, rng, times):
    rows = [dict(r) for r in rows]
    for _ in range(times):
        at, what = rng.randrange(len(rows)), rng.choice(["delete", "copy", "move", "edit", "edits", "key", "refused", "bad", "bads", "nonce", "clock", "root", "link", "swap", "fork", "pop"])
        run = range(at, min(len(rows), at + rng.randrange(2, 9)))
        if what == "delete":
            del rows[at : at + rng.randrange(1, 3)]
        elif what == "copy":
            rows.insert(rng.randrange(at + 1, len(rows) + 1), dict(rows[at]))
        elif what == "move":
            row = rows.pop(at)
            rows.insert(max(0, min(len(rows), at + rng.randrange(-6, 7))), row)
        elif what == "fork":
            rows.insert(rng.randrange(at + 1, len(rows) + 1), rows[at] | {"link": sha(rng.random()), "leaf": sha(rng.random())})
        elif what in ("edit", "key", "refused", "pop"):
            rows[at] |= {"sig": what, "link": sha(rng.random()), "leaf": sha(rng.random())} if what != "pop" else {"type": "key_rotation", "pop": False}
            if what == "refused":
                rows[at]["refused_at"] = 0
        elif what == "edits":
            for k in run:
                rows[k] |= {"sig": "edit", "link": sha(rng.random()), "leaf": sha(rng.random())}
        elif what in ("bad", "bads"):
            for k in [at] if what == "bad" else run:
                rows[k] |= {"problem": "malformed_record", "seq": None, "prev": None, "sig": None, "type": None, "nonce": None, "created": None, "leaf": sha(rng.random())}
        elif what == "nonce":
            rows[at]["nonce"] = rows[rng.randrange(len(rows))]["nonce"]
        elif what == "clock":
            rows[at]["created"] = "000000"
        elif what == "root":
            rows[at]["root"] = sha(1)
        elif what == "link":
            rows[at]["prev"] = sha(2)
        else:
            rows[at]["weights"] = "other"
        if not rows:
            return rows
    for p, r in enumerate(rows):
        r["pos"] = p
    return rows


def plain_walk(rows):
    """One pass from the first record to the last, with everything that it remembers in sets and lists."""
    found = {}

    def report(p, cause, n=None, effects=0):
        old = found.get((p, cause), (None, 0))
        found[p, cause] = (n if n is not None else old[0], old[1] + effects)

    seen, later = {}, [r["seq"] for r in rows]
    largest, holes, jumps = -1, 0, []  # jumps: (number before, number, position, is it a reorder)
    last = reach = taint = None
    nonces, registered, checkpoints, before, leaves, clock = set(), {}, {}, None, [], None
    for p, r in enumerate(rows):
        later.pop(0)
        if r["problem"]:
            report(p, r["problem"])
            last, reach, before = (p, r["problem"]), p, None
            taint = taint or last
            holes += 1
            leaves.append(bytes.fromhex(r["leaf"]))
            continue
        primary = []
        if r["seq"] in seen:
            old = seen[r["seq"]]
            primary.append(("record_replay" if old["link"] == r["link"] else "ledger_fork" if old["sig"] == r["sig"] == "ok" else "record_reorder", None))
        elif r["seq"] < largest:
            owner = next(j for j in jumps if j[0] < r["seq"] < j[1])
            if owner[3]:
                report(owner[2], "record_reorder", effects=1)
                last, reach = (owner[2], "record_reorder"), p
            else:
                primary.append(("record_reorder", None))
        else:
            between = range(largest + 1, r["seq"])
            come = sum(k in later for k in between)
            gone = len(between) - come - holes
            if gone > 0:
                primary.append(("record_delete", gone))
            elif come:
                primary.append(("record_reorder", None))
            if gone > 0 or come:
                jumps.append((largest, r["seq"], p, gone <= 0))
            largest, holes = r["seq"], 0
        seen.setdefault(r["seq"], r)
        if p == 0 and r["type"] != "genesis":
            primary.append(("genesis_mismatch", None))
        for cause, n in primary:
            report(p, cause, n)
            last, reach = (p, cause), p
            if cause != "genesis_mismatch":
                taint = taint or last
        if r["sig"] == "refused":
            report(r["refused_at"], "key_unauthorised", effects=1)
            last, reach = (r["refused_at"], "key_unauthorised"), p
        elif r["sig"] == "key":
            report(p, "key_unauthorised")
            last, reach = (p, "key_unauthorised"), p
            taint = taint or last
        elif r["sig"] == "edit":
            if last and last[1] == "record_edit" and reach == p - 1:
                report(*last, effects=1)
            else:
                report(p, "record_edit")
                last = (p, "record_edit")
                taint = taint or last
            reach = p
        if r["prev"] != (ledger.ZERO if p == 0 else before):
            if p == 0:
                report(p, "genesis_mismatch")
                last, reach = (p, "genesis_mismatch"), p
            elif last and reach >= p - 1:
                report(*last, effects=1)
            else:
                report(p, "chain_broken")
                last, reach = (p, "chain_broken"), p
        if r["sig"] == "ok":
            if r["nonce"] in nonces and ("record_replay", None) not in primary:
                report(p, "nonce_reuse")
                last, reach = (p, "nonce_reuse"), p
            nonces.add(r["nonce"])
            pop_bad = r["type"] == "key_rotation" and not r["pop"]
            tainted = taint or (pop_bad and (p, "key_unauthorised"))
            if r["type"] == "checkpoint":
                if r["tree_size"] == p and r["root"] == reference_root(leaves).hex():
                    checkpoints.setdefault(r["seq"], []).append((r["tree_size"], r["root"]))
                elif taint:
                    report(*taint, effects=1)
                else:
                    report(p, "checkpoint_mismatch")
                    last, reach = (p, "checkpoint_mismatch"), p
            if r["type"] == "anchor_event":
                if (r["tree_size"], r["root"]) not in checkpoints.get(r["checkpoint_seq"], []):
                    report(*tainted, effects=1) if tainted else report(p, "checkpoint_mismatch")
                nonces = {r["nonce"]}
            if r["type"] == "inference" and r["model_id"] is not None and registered.get(r["model_id"]) != r["weights"]:
                report(p, "model_swap")
                last, reach = (p, "model_swap"), p
            if r["type"] == "model_registration" and r["model_id"] is not None:
                registered[r["model_id"]] = r["weights"]
            if pop_bad:
                report(p, "key_unauthorised")
                last, reach = (p, "key_unauthorised"), p
                taint = taint or last
            if r["type"] == "degraded_marker":
                report(p, "degraded_gap")
        if clock is not None and r["created"] < clock:
            report(p, "clock_regression")
        clock, before = r["created"], r["link"]
        leaves.append(bytes.fromhex(r["leaf"]))
    return sorted((p, c, n, e) for (p, c), (n, e) in found.items())


def walked(spark, rows, width):
    table = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], walk.CHECKED).repartition(5)
    return sorted((r["pos"], r["cause"], r["n"], r["effects"]) for r in walk.walk(table, width=width).collect())


def test_sound_ledger(spark):
    rows = sound(60, random.Random(0))
    gaps = [(p, "degraded_gap", None, 0) for p, r in enumerate(rows) if r["type"] == "degraded_marker"]
    swaps = [(p, "model_swap", None, 0) for p, c, _, _ in plain_walk(rows) if c == "model_swap"]
    assert walked(spark, rows, 4096) == plain_walk(rows) == sorted(gaps + swaps)


@pytest.mark.parametrize("seed", range(4))
def test_random_damage(spark, seed):
    rng = random.Random(seed)
    rows = damaged(sound(70, rng), rng, 3 + seed * 3)
    found = walked(spark, rows, (2, 3, 5, 4096)[seed % 4])
    assert found == plain_walk(rows) and {f[1] for f in found} <= set(walk.CAUSES)


def test_nothing_and_one(spark):
    assert walked(spark, [], 4) == []
    one = sound(1, random.Random(1))
    assert walked(spark, one, 4) == []
    one[0]["prev"] = "ff"
    assert walked(spark, one, 4) == [(0, "genesis_mismatch", None, 0)]


def test_one_cause_through_many_runs(spark):
    """A ledger that is rewritten from one record on: one finding, whatever the width of runs."""
    rng = random.Random(3)
    rows = sound(60, rng)
    for r in rows[7:50]:
        r |= {"sig": "edit", "leaf": sha(rng.random()), "link": sha(rng.random())}
    want = plain_walk(rows)
    assert (7, "record_edit", None) in [w[:3] for w in want] and next(w[3] for w in want if w[1] == "record_edit") > 80
    for width in (2, 7):
        assert walked(spark, rows, width) == want


def test_summaries_compose():
    """Facts walked in runs by summaries, up and down, are the same as walked in one go; no Spark needed."""
    rng = random.Random(9)
    for trial in range(200):
        rows = []
        for p in range(rng.randrange(1, 60)):
            if rng.random() < 0.8:
                row = dict.fromkeys(walk.FACTS) | {"pos": p, "sig": rng.choice(["ok", "edit", "edit", "edit", "key"]), "link_bad": rng.random() < 0.6}
                row["cause"] = rng.choice([None] * 9 + ["record_replay"])
                rows.append(row)
        width = rng.choice([1, 2, 3])
        runs = {}
        for r in rows:
            runs.setdefault(r["pos"] // width, []).append(r)
        table = walk.pd.DataFrame([s for k, v in runs.items() for s in walk._summarise(v, k, width)], columns=["run", "way", "owner", "cause"])
        found = {}
        for run, owner, cause in walk._descend(table, 0, None, None):
            state = None if owner is None else walk.Open(owner, cause, run * width - 1)
            for row in runs[run]:
                more, state = walk.step(state, row)
                for pos, what, n, effects in more:
                    old = found.get((pos, what), (None, 0))
                    found[pos, what] = (n if n is not None else old[0], old[1] + effects)
        assert sorted((p, c, n, e) for (p, c), (n, e) in found.items()) == walk.walk_all(rows), trial


def test_unreadable_records_before_a_copy_are_not_missing(spark):
    """0, 1, two that don't read, a copy of 1, and 4: all that lies between 1 and 4 is there."""
    rows = [(0, 0, None, "a"), (1, 1, None, "b"), (2, None, "malformed_record", "x"), (3, None, "malformed_record", "y"), (4, 1, None, "b"), (5, 4, None, "e")]
    checked = walk.as_checked(spark.createDataFrame([(*r, "ok") for r in rows], "pos long, seq long, problem string, link string, sig string"))
    assert [(r["pos"], r["cause"], r["n"]) for r in walk._numbers(checked).collect()] == [(4, "record_replay", None)]


def test_numbers_are_carried_from_run_to_run(spark):
    """The largest number so far, and what is unreadable before it, is the same whatever the width of runs."""
    rng = random.Random(16)
    rows = damaged(sound(60, rng), rng, 24)
    table = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in [dict(r, pos=p) for p, r in enumerate(rows)]], walk.CHECKED).repartition(3)
    found = [sorted(map(tuple, walk._numbers(table, width).collect()), key=str) for width in (3, 4096)]
    assert found[0] == found[1] and {f[1] for f in found[0]} >= {"record_reorder", "record_replay", "ledger_fork", "record_delete"}


def test_a_walk_stores_little(spark):
    """What is stored of a ledger on the way is its records once, and a few numbers of each."""
    from pathlib import Path

    from veristrata.plans.chains import verify_walk
    from veristrata.sources.session import checkpoint_dir

    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before, events = held(), spark.read.parquet("/root/testdata/sf0.01/events.parquet").count()
    assert verify_walk(spark, "/root/testdata/sf0.01").count() == 347
    assert held() - before < 600 * events
