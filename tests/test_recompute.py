"""The recompute driver with plug-ins, sealed forms, canonical numbers and control regions."""

import hashlib
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veristrata.functions import canonical
from veristrata.operators import recompute

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def make(task="classify", with_bytes=True):
    """Confidences are the input's bytes over 255; two classes, or a box each."""

    def decode(raw):
        items = [{"cls": k, "conf": v} for k, v in enumerate(raw)]
        if task == "detect":
            return [i | {"box": [i["conf"], 2.0, 3.0 + i["conf"], 4.5]} for i in items]
        return sorted(items, key=lambda i: (-i["conf"], i["cls"]))

    return recompute.Functions("r1", task, lambda data, kind: [b / 255 for b in data], lambda batch: batch, decode, (lambda p: bytes(round(x * 255) for x in p)) if with_bytes else None)


def record(seq, data=b"\x80\x10", task="classify", **change):
    fine, coarse = recompute._row_texts(task, make(task).decode([b / 255 for b in data]))
    row = {"seq": seq, "weights": "w", "source_kind": "encoded_file", "input_sha256": sha(data), "jcs_sha256": sha(fine), "decision_sha256": sha(coarse), "runtime": "r1", "data": data, "sealed_fine": fine}
    return row | change


SHAPE = "seq long, weights string, source_kind string, input_sha256 string, jcs_sha256 string, decision_sha256 string, runtime string, data binary, sealed_fine string"


def verdicts(spark, rows, load=make, digest="w"):
    table = spark.createDataFrame([tuple(r[c.split()[0]] for c in SHAPE.split(", ")) for r in rows], SHAPE).repartition(3)
    return {r["seq"]: (r["verdict"], r["reason"]) for r in recompute.recompute(table, load, digest).collect()}


def test_verdicts(spark):
    tie = json.dumps({"task": "classify", "top": [{"cls": 1, "conf_e6": 501961}, {"cls": 0, "conf_e6": 501920}]}, sort_keys=True, separators=(",", ":"))
    other = tie.replace("501920", "400000")
    near = b"\x80\x80"  # two classes of one confidence
    rows = [
        record(0), record(1, source_kind="model_input_tensor"), record(2, runtime="r0"), record(3, jcs_sha256="0"), record(4, weights="x"), record(5) | {"data": None}, record(6, input_sha256="0"),
        record(7, near, jcs_sha256=sha(tie), decision_sha256="0", sealed_fine=tie), record(8, near, jcs_sha256=sha(other), decision_sha256="0", sealed_fine=other), record(9, near, jcs_sha256=sha(tie), decision_sha256="0", sealed_fine=None), record(10, near, jcs_sha256="0", decision_sha256="0", sealed_fine=tie),
    ]
    want = {0: "verified_exact", 1: "verified_exact", 2: "verified_decision", 3: "verified_decision", 4: "model_swap", 5: "skipped", 6: "input_swap", 7: "boundary_flip", 8: "output_mismatch", 9: "output_mismatch", 10: "output_mismatch"}
    got = verdicts(spark, rows)
    assert {k: v for k, (v, _) in got.items()} == want and got[5] == ("skipped", "no input")
    assert set(verdicts(spark, rows[:3], digest=None).values()) == {("skipped", "no digest of the model")}
    blind = verdicts(spark, rows[:2], load=lambda: make(with_bytes=False))
    assert blind[0][0] == "verified_exact" and blind[1][0] == "skipped"
    assert verdicts(spark, []) == {}


def test_boxes(spark):
    fine, coarse = recompute._row_texts("detect", make("detect").decode([0.5, 0.25]))
    moved = fine.replace('"box_q64":[32,', '"box_q64":[31,')
    far = fine.replace('"box_q64":[32,', '"box_q64":[200,')
    data = bytes([0x80, 0x40])
    exact = record(0, data, "detect")
    rows = [exact, exact | {"seq": 1, "sealed_fine": far, "jcs_sha256": sha(far), "decision_sha256": "0"}]
    got = verdicts(spark, rows, load=lambda: make("detect"))
    assert got[0][0] == "verified_exact" and got[1][0] == "output_mismatch"
    assert recompute.near_tie(json.loads(moved), make("detect").decode([0.5, 0.25]), 1e-4, 1e-3) and not recompute.near_tie(json.loads(far), make("detect").decode([0.5, 0.25]), 1e-4, 1e-3)


def test_forms_in_columns_and_rows_agree(spark):
    outputs = [
        [{"cls": 3, "conf": 0.1234565, "box": [0.5, -0.5, 1.49999, 640.0078125]}, {"cls": 1, "conf": 1.5, "box": [1.0, 2.0, 3.0, 4.0]}, {"cls": 1, "conf": -0.1, "box": [1.0, 1.5, 3.0, 4.0]}],
        [], [{"cls": 2, "conf": float("nan"), "box": [1.0, 1.0, 1.0, 1.0]}], [{"cls": 2, "conf": 0.5, "box": [float("inf"), 1.0, 1.0, 1.0]}],
    ]
    table = spark.createDataFrame([(k, [(i["cls"], i["conf"], i["box"]) for i in o]) for k, o in enumerate(outputs)], f"k int, items {recompute.ITEMS}")
    for task in ("classify", "detect"):
        got = {r["k"]: (r["fine"], r["coarse"]) for r in table.select("k", *(recompute.output_text(F.lit(task), F.col("items"), f).alias(f) for f in ("fine", "coarse"))).collect()}
        assert got == {k: recompute._row_texts(task, o) for k, o in enumerate(outputs)}
    limited = table.where("k = 1").select(recompute.output_text(F.lit("detect"), F.col("items"), "fine", F.lit(0.25), F.lit(0.5)).alias("t")).first()["t"]
    assert limited == '{"detections":[],"filter":{"conf_thr_e6":250000,"nms_iou_e6":500000},"task":"detect"}'


def test_choice_by_class(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"c{i % 4}") for i in range(300)], "seq long, cls string")
    flagged = spark.createDataFrame([(5,), (5,), (7,), (999,)], "seq long")
    pick = lambda seed: sorted((r["seq"], r["cls"], r["chosen"]) for r in recompute.choose(rows.repartition(4), flagged, 6, seed).collect())
    got = pick(1)
    assert [r[0] for r in got if r[2] == "flagged"] == [5, 7]
    sampled = [r for r in got if r[2] == "sampled"]
    assert {c: sum(r[1] == c for r in sampled) for c in ("hot", "c0", "c1", "c2", "c3")} == dict.fromkeys(("hot", "c0", "c1", "c2", "c3"), 6)
    assert got == pick(1) != pick(2)


def test_control_regions(spark):
    rows = spark.createDataFrame([(1, [2, 2, 4, 5]), (2, [0, 0, 8, 8]), (3, [0, 0, 1, 1])], "id int, r array<int>")
    got = {r["id"]: r["c"] for r in rows.select("id", recompute.control_regions(F.col("r"), 8, 10, F.col("id")).alias("c")).collect()}
    assert got[2] == [] and len(got[1]) == len(got[3]) == 10 and got[1] == sorted(got[1])
    assert all(c - a == 2 and d - b == 3 and 0 <= a and c <= 8 and 0 <= b and d <= 8 and (c <= 2 or a >= 4 or d <= 2 or b >= 5) for a, b, c, d in got[1])


# RFC 8785, appendix B: what a double's bits are written as
NUMBERS = [(0x0000000000000000, "0"), (0x8000000000000000, "0"), (0x0000000000000001, "5e-324"), (0x8000000000000001, "-5e-324"), (0x7FEFFFFFFFFFFFFF, "1.7976931348623157e+308"), (0x4340000000000000, "9007199254740992"), (0x4430000000000000, "295147905179352830000"), (0x44B52D02C7E14AF5, "9.999999999999997e+22"), (0x44B52D02C7E14AF6, "1e+23"), (0x444B1AE4D6E2EF4E, "999999999999999700000"), (0x444B1AE4D6E2EF50, "1e+21"), (0x3EB0C6F7A0B5ED8C, "9.999999999999997e-7"), (0x3EB0C6F7A0B5ED8D, "0.000001"), (0x41B3DE4355555553, "333333333.3333332"), (0x41B3DE4355555557, "333333333.33333343"), (0xBECBF647612F3696, "-0.0000033333333333333333")]


@pytest.mark.parametrize("bits, text", NUMBERS)
def test_rfc_8785_numbers(bits, text):
    import struct

    assert canonical.number(struct.unpack(">d", bits.to_bytes(8, "big"))[0]) == text


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_read_back(x):
    assert float(canonical.number(x)) == x


def test_any_value():
    assert canonical.encode_any({"b": 1.0, "a": {"x": {3, 1}, "é": [0.1, None, True, 1e21]}, 5: "t"}) == '{"5":"t","a":{"x":["1","3"],"é":[0.1,null,true,1e+21]},"b":1}'
    assert canonical.encode_any({"": 1, "\U0001f600": 2}).index("\U0001f600") < 8  # UTF-16 order, not code points
    with pytest.raises(ValueError):
        canonical.encode_any([math.nan])
