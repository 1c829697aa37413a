"""Registered queries without SQL: their results on the small tables against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SMALL
from veristrata import catalog
from veristrata.functions import stats
from veristrata.operators import labels
from veristrata.plans.more_queries import _vectors


def read(name, columns=None):
    return pd.read_parquet(f"{SMALL}/{name}.parquet", columns=columns)


def run(spark, name):
    return catalog.QUERIES[name](spark, SMALL)


def predictions():
    l = read("lineitem")
    flag, s = l["l_returnflag"], l["l_suppkey"] % 10
    guess = np.where((s == 3) & (l["l_linenumber"] > 3) & (flag == "A"), "N", np.where(l["l_partkey"] % 11 == 0, "R", flag))
    return pd.DataFrame({"contributor": "c" + s.astype(str), "label": flag, "predicted": guess})


def test_mislabel_tests(spark):
    rows = predictions()
    size = rows.groupby(["contributor", "label"]).size()
    wrong = rows[rows["label"] != rows["predicted"]].groupby(["contributor", "label", "predicted"]).size()
    family = len(wrong)
    want = {}
    for (c, lab, p), hits in wrong.items():
        n = size[c, lab]
        peers = {d: (wrong.get((d, lab, p), 0), size[d, lab]) for d in rows["contributor"].unique() if d != c and (d, lab) in size.index}
        peer_hits, peer_n = sum(v[0] for v in peers.values()), sum(v[1] for v in peers.values())
        worst = max((k / m for k, m in peers.values()), default=0.0)
        total, all_hits = n + peer_n, hits + peer_hits
        tail = sum(math.comb(int(all_hits), i) * math.comb(int(total - all_hits), int(n) - i) for i in range(int(hits), int(min(n, all_hits)) + 1)) / math.comb(int(total), int(n))
        adjusted = min(1.0, tail * family)
        want[c, lab, p] = (n, hits, worst, adjusted, bool(hits / n >= 0.25 and hits / n - worst >= 0.2 and adjusted < 0.01 and peers))
    got = {(r["contributor"], r["label"], r["predicted"]): r for r in run(spark, "A24_mislabel_tests").collect()}
    assert got.keys() == want.keys() and any(v[4] for v in want.values())
    for k, (n, hits, worst, p, flagged) in want.items():
        assert (got[k]["n"], got[k]["hits"], got[k]["flagged"]) == (n, hits, flagged)
        assert got[k]["worst_peer"] == pytest.approx(worst) and got[k]["p"] == pytest.approx(p, rel=1e-6, abs=1e-12)


def test_isotonic_steps(spark):
    o = read("orders")
    rows = pd.DataFrame({"d": "d" + (o["o_custkey"] % 4).astype(str), "score": np.sign(o["o_totalprice"]) * np.floor(np.abs(o["o_totalprice"]) / 1000 + 0.5), "y": (o["o_orderstatus"] == "F").astype(float)})
    got = {r["detector_id"]: r for r in run(spark, "A55_isotonic_steps").collect()}
    assert got.keys() == set(rows["d"])
    for d, part in rows.groupby("d"):
        each = part.groupby("score")["y"].agg(["sum", "count"]).reset_index()
        w, m = each["count"].to_numpy(float), (each["sum"] / each["count"]).to_numpy()
        # the fit at i is the largest, over starts up to i, of the smallest mean of a run from there that reaches i
        k, n = np.concatenate([[0], np.cumsum(m * w)]), np.concatenate([[0], np.cumsum(w)])
        size = len(m)
        fit = [max(min((k[e + 1] - k[s]) / (n[e + 1] - n[s]) for e in range(i, size)) for s in range(i + 1)) for i in range(size)]
        edges, levels = got[d]["edges"], got[d]["levels"]
        assert levels == sorted(levels) and edges == sorted(edges)
        stepped = [levels[min(np.searchsorted(edges, s - 1e-9), len(levels) - 1)] for s in each["score"]]
        assert stepped == pytest.approx(fit)


def test_spectral_scores(spark):
    e = read("embeddings")
    want = {}
    for _, part in e.groupby("label"):
        x = np.stack(part["embedding"].to_numpy()).astype(float)
        if len(x) >= 20:
            x = x - x.mean(0)
            values, vectors = np.linalg.eigh(x.T @ x)
            want |= {i: (s, values[-1] / values[-2]) for i, s in zip(part["vec_id"], (x @ vectors[:, -1]) ** 2, strict=True)}
    got = {r["id"]: r["score"] for r in run(spark, "A62_spectral_scores").collect()}
    assert got.keys() == want.keys() and got
    clear = [i for i, (_, gap) in want.items() if gap > 1.5]  # thirty steps of the power method are exact enough there
    for i in clear:
        assert got[i] == pytest.approx(want[i][0], rel=0.05, abs=0.05 * max(s for s, _ in want.values()))
    # elsewhere no direction can hold more than the first
    total = sum(s for s, _ in want.values())
    assert 0.85 * total <= sum(got.values()) <= total * 1.000001


def test_confident_errors(spark):
    probs = labels.out_of_fold(_vectors(spark, SMALL), folds=3).toPandas()
    p = np.stack(probs["probs"].to_numpy())
    limit = {c: p[(probs["label"] == c).to_numpy(), c].mean() for c in probs["label"].unique()}
    want = {}
    for i, lab, row in zip(probs["id"], probs["label"], p, strict=True):
        over = [(row[c], -c) for c in limit if row[c] >= limit[c]]
        if over:
            c = -max(over)[1]
            if c != lab and row[c] > row[lab]:
                want[i] = (lab, c, pytest.approx(row[c] - row[lab], abs=1e-6))
    got = {r["id"]: (r["label"], r["suggested"], r["margin"]) for r in run(spark, "A30_confident_errors").collect()}
    assert got.keys() == want.keys() and all(got[i] == v for i, v in want.items())


def test_material_shift(spark):
    l = read("lineitem")
    half = l["l_orderkey"] % 2
    axes = {"price": l["l_extendedprice"], "quantity": l["l_quantity"] + 3 * half, "discount": l["l_discount"]}
    want, family = {}, []
    for name, v in axes.items():
        edges = np.unique(np.quantile(v, [i / 10 for i in range(1, 10)]))
        cells = np.searchsorted(edges, v, "right")
        used = np.unique(cells)
        a, b = (np.array([((cells == c) & (half == h)).sum() for c in used]) for h in (0, 1))
        p, q = (a + 0.5) / (a.sum() + 0.5 * len(used)), (b + 0.5) / (b.sum() + 0.5 * len(used))
        psi = float(((p - q) * np.log(p / q)).sum())
        values = np.unique(v)
        r, i = np.sort(v[half == 0]), np.sort(v[half == 1])
        ks = float(np.abs(np.searchsorted(r, values, "right") / len(r) - np.searchsorted(i, values, "right") / len(i)).max())
        want[name] = (psi, ks)
        family += [(stats.psi_p_value(psi, len(r), len(i), len(used)), name), (stats.ks_p_value(ks, len(r), len(i))[0], name)]
    family.sort()
    least, q = 1.0, {}
    for k in range(len(family), 0, -1):
        least = min(least, family[k - 1][0] * len(family) / k)
        q[family[k - 1][1]] = min(q.get(family[k - 1][1], 1.0), least)
    got = {r["axis"]: r for r in run(spark, "A14_material_shift").collect()}
    assert got.keys() == want.keys()
    for name, (psi, ks) in want.items():
        assert (got[name]["psi"], got[name]["ks"]) == (pytest.approx(psi), pytest.approx(ks))
        assert got[name]["q"] == pytest.approx(q[name], rel=1e-6)
        assert got[name]["material"] == (q[name] <= 0.01 and ks >= 0.1)


def analyst_events():
    e = read("events", ["event_id", "user_id"]).sort_values("event_id")
    words = ("assign", "acknowledge", "override", "approve", "quarantine", "release")
    out = []
    for i, u in zip(e["event_id"], e["user_id"], strict=True):
        action = words[i // 6 % 2 * 3 + i % 3]
        refs = i - (4 if i % 2 == 0 else 5) if action == "approve" else None
        out.append({"seq": i, "actor": f"u{u % 5}", "action": action, "new": ("quarantine", "accept", "review")[i % 3], "ref": str(i // 12 % 400), "refs": refs})
    return out


def test_folds(spark):
    """The rules again, as one loop over all events with plain dictionaries."""
    events = analyst_events()
    released = {e["seq"] for e in events if e["action"] == "release"}
    routed = {r["finding_id"]: (r["target_ref"], r["disposition"]) for r in catalog.QUERIES["P13_rule_table"](spark, SMALL).join(catalog.QUERIES["F02_finding_id"](spark, SMALL), "finding_id").collect()}
    rank = {"accept": 0, "review": 1, "quarantine": 2}
    of: dict = {}
    for f, (ref, _) in routed.items():
        of.setdefault(ref, []).append(f)
    state = {f: {"now": d, "wait": None, "last": -1, "cited": None} for f, (_, d) in routed.items()}
    target: dict = {}
    for e in events:
        on_target = e["action"] in ("quarantine", "release") or (e["refs"] in released and e["refs"] < e["seq"])
        if on_target:
            t = target.setdefault(e["ref"], {"status": "active", "wait": None, "last": -1, "cited": None})
            t["last"] = e["seq"]
            if e["action"] == "quarantine":
                t.update(status="quarantined", wait=None, cited=e["seq"])
            elif e["action"] == "release":
                t["wait"] = (e["seq"], e["actor"])
            elif t["wait"] and t["wait"][0] == e["refs"] and t["wait"][1] != e["actor"]:
                t.update(status="active", wait=None, cited=e["seq"])
            continue
        for f in of.get(e["ref"], ()):
            s = state[f]
            s["last"] = e["seq"]
            if e["action"] == "override":
                if rank[e["new"]] > rank[s["now"]]:
                    s.update(now=e["new"], cited=e["seq"], wait=None)
                else:
                    s["wait"] = (e["seq"], e["actor"], e["new"])
            elif e["action"] == "approve" and s["wait"] and s["wait"][0] == e["refs"] and s["wait"][1] != e["actor"]:
                s.update(now=s["wait"][2], cited=e["seq"], wait=None)
    got = {r["finding_id"]: (r["disposition"], r["pending_seq"], r["last_seq"], r["cited_seq"]) for r in run(spark, "L17_event_fold").collect()}
    assert got == {f: (s["now"], s["wait"] and s["wait"][0], s["last"], s["cited"]) for f, s in state.items()}
    targets = {r["target_ref"]: (r["status"], r["pending_seq"], r["last_seq"], r["cited_seq"]) for r in run(spark, "L17_target_fold").collect()}
    assert targets == {k: (t["status"], t["wait"] and t["wait"][0], t["last"], t["cited"]) for k, t in target.items()}
