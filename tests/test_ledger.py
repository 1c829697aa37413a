"""Merkle trees, proofs and event folds."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veristrata.operators import governance, ledger
from veristrata.streaming.events import MerkleAccumulator


def reference_root(leaves):
    """RFC 6962, section 2.1, by its recursion."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << ((len(leaves) - 1).bit_length() - 1)
    return hashlib.sha256(b"\x01" + reference_root(leaves[:k]) + reference_root(leaves[k:])).digest()


def leaf(i):
    return hashlib.sha256(b"\x00" + f"r{i}".encode()).digest()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 13])
def test_roots_and_proofs(spark, n):
    rows = spark.range(n).select(F.col("id").alias("idx"), ledger.leaf_hash(F.concat(F.lit("r"), F.col("id").cast("string"))).alias("hash"))
    nodes = ledger.merkle_levels(rows).cache()
    tree = ledger.StoredTree(nodes, n)
    leaves = [leaf(i) for i in range(n)]
    root = reference_root(leaves)
    assert tree.root() == root
    assert ledger.merkle_root(rows) == root.hex()
    for i in {0, n // 2, n - 1}:
        assert ledger.verify_inclusion(leaves[i], i, n, tree.inclusion(i), root)
        assert not ledger.verify_inclusion(leaf(99), i, n, tree.inclusion(i), root)
    for m in {1, n // 2, n} - {0}:
        old = reference_root(leaves[:m])
        assert tree.root(m) == old
        assert ledger.verify_consistency(m, n, tree.consistency(m), old, root)


def test_accumulator():
    tree = MerkleAccumulator()
    for n in range(1, 40):
        tree.append(leaf(n - 1))
        assert tree.root() == reference_root([leaf(i) for i in range(n)]).hex()


#: (seq, actor, action, refs_seq, new disposition) and what holds after it: disposition, pending seq, last seq.
STORY = [
    (1, "a", "override", None, "accept", ("review", 1, 1)),  # lowering waits
    (2, "a", "approve", 1, None, ("review", 1, 2)),  # the same person can't approve
    (3, "b", "approve", 7, None, ("review", 1, 3)),  # nor by another number
    (4, "c", "override", None, "accept", ("review", 4, 4)),  # a later request takes the place of the first
    (5, "b", "approve", 1, None, ("review", 4, 5)),  # which can't be approved any more
    (6, "b", "approve", 4, None, ("accept", None, 6)),
    (7, "a", "override", None, "quarantine", ("quarantine", None, 7)),  # raising takes effect at once
    (8, "a", "acknowledge", None, None, ("quarantine", None, 8)),
    (9, "a", "acknowledge", None, None, ("quarantine", None, 9)),
    (10, "a", "override", None, "quarantine", ("quarantine", 10, 10)),  # the same again isn't raising
    (11, "b", "assign", None, None, ("quarantine", 10, 11)),
]


def test_fold_rules():
    s = governance.new_state("f", "review")
    for seq, actor, action, refs, new, want in STORY:
        s = governance.step(s, {"seq": seq, "actor_id": actor, "action": action, "refs_seq": refs, "new_disposition": new, "assignee": "x"})
        assert (s["disposition"], s["pending_seq"], s["last_seq"]) == want, seq
    assert s["original"] == "review" and s["superseded"] == [1] and s["acknowledged_by"] == ["a"] and s["assignee"] == "x" and s["cited_seq"] == 7
    assert governance.admissible(s, {"action": "assign", "actor_id": "b", "expected_prev_seq": 3}) == "stale"
    assert governance.admissible(s, {"action": "approve", "actor_id": "a", "refs_seq": 10}) == "same_person"
    assert governance.admissible(s, {"action": "approve", "actor_id": "b", "refs_seq": 1}) == "nothing_to_approve"


def test_fold_of_findings_and_targets(spark):
    """Quarantine and release are the target's; an approval goes where the change that it names is."""
    rows = [(1, "a", "quarantine", None, "s1"), (2, "a", "release", None, "s1"), (3, "a", "approve", 2, "s1"), (4, "a", "override", None, "s1"), (5, "b", "approve", 2, "s1"), (6, "b", "approve", 4, "s1"), (7, "c", "release", None, "s2"), (8, "c", "quarantine", None, "s2"), (9, "d", "approve", 7, "s2"), (10, "d", "approve", 99, "s3")]
    e = spark.createDataFrame([(*r, f"f{r[4]}", "accept", None, "sample") for r in rows], "seq long, actor_id string, action string, refs_seq long, target_ref string, finding_id string, new_disposition string, assignee string, target_type string")
    found = spark.createDataFrame([("fs1", "quarantine"), ("fs2", "review"), ("fs9", "accept")], "finding_id string, disposition string")
    got = {r["finding_id"]: (r["disposition"], r["last_seq"], r["cited_seq"]) for r in governance.fold(found, e).collect()}
    assert got == {"fs1": ("accept", 6, 6), "fs2": ("review", -1, None), "fs9": ("accept", -1, None)}
    targets = {r["target_ref"]: (r["status"], r["pending_seq"], r["cited_seq"], r["last_seq"]) for r in governance.fold_targets(e).collect()}
    assert targets == {"s1": ("active", None, 5, 5), "s2": ("quarantined", None, 8, 9)}
    assert governance.fold_targets(e.limit(0)).count() == 0


def test_in_order_crosses_runs(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in (0, 1, 5, 9, 30, 31)], "seq long, v string")
    got = {r["seq"]: r["p"] for r in ledger.in_order(rows, {"p": "v"}, width=4).collect()}
    assert got == {0: None, 1: "v0", 5: "v1", 9: "v5", 30: "v9", 31: "v30"}


def test_folds_hold_a_batch_and_one_state(spark):
    """A finding's and a target's events are folded over batches that cut them anywhere, never as one group in Python."""
    actions = ["acknowledge", "override", "approve", "assign"]
    rows = [(i, f"f{i % 3}", f"u{i % 4}", actions[i // 3 % 4], i - 3 if actions[i // 3 % 4] == "approve" else None, "accept", "u9", "sample", f"t{i % 2}") for i in range(200)]
    told = [(i + 200, None, f"u{i % 4}", ("quarantine", "release")[i % 2], None, None, None, "sample", f"t{i % 2}") for i in range(50)]
    e = spark.createDataFrame(rows + told, "seq long, finding_id string, actor_id string, action string, refs_seq long, new_disposition string, assignee string, target_type string, target_ref string")
    found = spark.createDataFrame([(f"f{k}", "review") for k in range(5)], "finding_id string, disposition string")
    plain = [{k: v for k, v in r.asDict().items()} for r in e.orderBy("seq").collect()]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        folds = governance.fold(found, e), governance.fold_targets(e)
        states = [{r[0]: tuple(r) for r in f.collect()} for f in folds[:1]]
        assert all("InPandas" in p and "GroupsInPandas" not in p for p in (f._jdf.queryExecution().executedPlan().toString() for f in folds))
    finally:
        spark.conf.set(key, old)
    names = [c.split()[0] for c in governance.STATE.split(", ")]
    not_target = [r for r in plain if r["seq"] < 200 and r["action"] not in governance.ON_TARGETS]
    want = {f"f{k}": governance.fold_all(governance.new_state(f"f{k}", "review"), [r for r in not_target if r["finding_id"] == f"f{k}"]) for k in range(5)}
    listed = lambda v: list(v) if isinstance(v, (list, tuple)) else v
    assert {k: [listed(x) for x in v] for k, v in states[0].items()} == {k: [listed(s[n]) for n in names] for k, s in want.items()}
