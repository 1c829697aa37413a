"""Recomputing sealed inferences: which records, by which pipeline, and what each comparison shows.

A pipeline is a plug-in (``Pipeline``): it is loaded once in each task and asked
batch by batch. What it returns is brought to the quantised forms that records
seal (``output_text``), and compared by hash, then by the stored decisions.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scales of the sealed forms, and what counts as jitter of floating point.
CONF, BOX = 1_000_000, 64
EPS_CONF, EPS_PX = 1e-4, 1e-3
#: What a record's comparison may show.
VERDICTS = ("verified_exact", "verified_decision", "boundary_flip", "output_mismatch", "input_swap", "model_swap", "skipped")
ITEMS = "array<struct<cls:int,conf:double,box:array<double>>>"


# ---- sealed forms, as columns ----


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _confidence(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(CONF), _half_up(x * CONF))).cast("string")


def _list(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def _numbers(box: Column, scale: int) -> Column:
    return F.transform(box, lambda x: _half_up(x * scale).cast("bigint"))


def _finite(items: Column) -> Column:
    odd = lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return ~F.exists(items, lambda i: odd(i["conf"]) | F.coalesce(F.exists(i["box"], odd), F.lit(False)))


def output_text(task: Column, items: Column, form: str, conf_thr: Column | None = None, nms_iou: Column | None = None) -> Column:
    """Canonical JSON of a model's output (task ``classify`` or ``detect``; items of ``ITEMS``), ``fine`` or ``coarse``.

    Fine: confidences in millionths, boxes in 64ths. Coarse: no confidences, boxes
    in whole pixels, detections ordered by class and box. Halves go up. An output
    that isn't finite is sealed as just that.
    """
    cls = lambda i: F.concat(F.lit('"cls":'), i["cls"].cast("string"))
    box = lambda i, name, scale: F.concat(F.lit(f'"{name}":'), _list(F.transform(_numbers(i["box"], scale), lambda x: x.cast("string"))))
    if form == "fine":
        conf = lambda i: F.concat(F.lit('"conf_e6":'), _confidence(i["conf"]))
        top = F.transform(items, lambda i: F.concat(F.lit("{"), cls(i), F.lit(","), conf(i), F.lit("}")))
        found = F.transform(items, lambda i: F.concat(F.lit("{"), box(i, "box_q64", BOX), F.lit(","), cls(i), F.lit(","), conf(i), F.lit("}")))
    else:
        top = F.transform(items, lambda i: F.concat(F.lit("{"), cls(i), F.lit("}")))
        ordered = F.array_sort(F.transform(items, lambda i: F.struct(i["cls"].alias("cls"), _numbers(i["box"], 1).alias("px"), F.concat(F.lit("{"), box(i, "box_px", 1), F.lit(","), cls(i), F.lit("}")).alias("text"))))
        found = F.transform(ordered, lambda x: x["text"])
    limits = F.lit("")
    if conf_thr is not None and nms_iou is not None:
        limits = F.concat(F.lit('"filter":{"conf_thr_e6":'), _confidence(conf_thr), F.lit(',"nms_iou_e6":'), _confidence(nms_iou), F.lit("},"))
    classify = F.concat(F.lit("{"), limits, F.lit('"task":"classify","top":'), _list(top), F.lit("}"))
    detect = F.concat(F.lit('{"detections":'), _list(found), F.lit(","), limits, F.lit('"task":"detect"}'))
    return F.when(_finite(items), F.when(task == "classify", classify).otherwise(detect)).otherwise(F.lit('{"nonfinite":true}'))


def _row_texts(task: str, items: Sequence[Mapping]) -> tuple[str, str]:
    """The same two forms of one output, where rows are in Python's hands."""
    up = lambda x: math.floor(x + 0.5)
    numbers = [v for i in items for v in (i["conf"], *(i.get("box") or ()))]
    if not all(map(math.isfinite, numbers)):
        return ('{"nonfinite":true}',) * 2
    conf = lambda i: max(0, min(CONF, up(i["conf"] * CONF)))
    if task == "classify":
        fine, coarse = [{"cls": i["cls"], "conf_e6": conf(i)} for i in items], [{"cls": i["cls"]} for i in items]
    else:
        fine = [{"cls": i["cls"], "conf_e6": conf(i), "box_q64": [up(x * BOX) for x in i["box"]]} for i in items]
        coarse = sorted(({"cls": i["cls"], "box_px": [up(x) for x in i["box"]]} for i in items), key=lambda d: (d["cls"], d["box_px"]))
    key = "top" if task == "classify" else "detections"
    text = lambda found: json.dumps({"task": task, key: found}, sort_keys=True, separators=(",", ":"))
    return text(fine), text(coarse)


# ---- which records ----


def choose(records: DataFrame, flagged: DataFrame, per_class: int, seed: int, by: str = "cls") -> DataFrame:
    """Records to recompute: all that are ``flagged`` (seq), and of the rest ``per_class`` of each class, by a hash of seed and number. ``chosen`` tells which."""
    marked = records.join(flagged.select("seq").distinct().withColumn("__flagged", F.lit(True)), "seq", "left")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("seq").cast("string")).cast("binary"))
    drawn = marked.where("__flagged is null").withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(order, "seq"))).where(F.col("__place") <= per_class)
    return marked.where("__flagged").withColumn("chosen", F.lit("flagged")).drop("__flagged").unionByName(drawn.withColumn("chosen", F.lit("sampled")).drop("__flagged", "__place"))


def control_regions(region: Column, grid: int, k: int, seed: Column) -> Column:
    """``k`` regions of a region's size (r0, c0, r1, c1) inside a grid that don't overlap it, without replacement, by a hash of the seed; in order of rows."""
    r0, c0, r1, c1 = (region[i] for i in range(4))
    h, w = r1 - r0, c1 - c0
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda c: F.struct(r.alias("r"), c.alias("c")))))
    able = F.filter(places, lambda p: (p["r"] + h <= grid) & (p["c"] + w <= grid) & ((p["r"] + h <= r0) | (p["r"] >= r1) | (p["c"] + w <= c0) | (p["c"] >= c1)))
    keyed = F.transform(able, lambda p: F.struct(F.md5(F.concat_ws(":", seed.cast("string"), p["r"].cast("string"), p["c"].cast("string")).cast("binary")).alias("key"), p["r"].alias("r"), p["c"].alias("c")))
    drawn = F.array_sort(F.transform(F.slice(F.array_sort(keyed), 1, k), lambda p: F.struct(p["r"].alias("r"), p["c"].alias("c"))))
    return F.transform(drawn, lambda p: F.array(p["r"], p["c"], p["r"] + h, p["c"] + w))


# ---- plug-ins ----


class Pipeline(Protocol):
    """What a field pipeline does with an input, to seal and to recompute."""

    runtime: str
    task: str

    def prepare(self, data: bytes, kind: str) -> Any:
        """Decode an input and bring it to the model's form."""

    def tensor_bytes(self, prepared: Any) -> bytes:
        """The model's input as bytes, for records that sealed its hash; NotImplementedError if it has none."""

    def infer(self, prepared: Sequence[Any]) -> Sequence[Any]:
        """Run the model on a batch."""

    def decode(self, raw: Any) -> list[dict]:
        """One output's items: cls, conf, and box for detections."""


@dataclass
class Functions:
    """A pipeline of plain functions."""

    runtime: str
    task: str
    prepare_with: Callable[[bytes, str], Any]
    infer_with: Callable[[Sequence[Any]], Sequence[Any]]
    decode_with: Callable[[Any], list[dict]]
    bytes_with: Callable[[Any], bytes] | None = None

    def prepare(self, data: bytes, kind: str) -> Any:
        return self.prepare_with(data, kind)

    def tensor_bytes(self, prepared: Any) -> bytes:
        if self.bytes_with is None:
            raise NotImplementedError
        return self.bytes_with(prepared)

    def infer(self, prepared: Sequence[Any]) -> Sequence[Any]:
        return self.infer_with(prepared)

    def decode(self, raw: Any) -> list[dict]:
        return self.decode_with(raw)


Loader = Callable[[], Pipeline]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def near_tie(sealed: Mapping, items: Sequence[Mapping], eps_conf: float, eps_px: float) -> bool:
    """Could jitter alone explain another decision? Ranks whose classes differ must be ties; boxes may only straddle a pixel's edge."""
    if "top" in sealed:
        old = [(d["cls"], d["conf_e6"] / CONF) for d in sealed["top"]]
        return len(old) == len(items) and all(c == i["cls"] or abs(p - i["conf"]) <= eps_conf for (c, p), i in zip(old, items, strict=True))
    if "detections" in sealed and all(i.get("box") for i in items):
        old = sorted((d["cls"], [x / BOX for x in d["box_q64"]]) for d in sealed["detections"])
        new = sorted((i["cls"], list(i["box"])) for i in items)
        up = lambda x: math.floor(x + 0.5)
        same = lambda a, b: up(a) == up(b) or abs(a - b) <= eps_px + 1 / BOX
        return len(old) == len(new) and all(a[0] == b[0] and all(map(same, a[1], b[1])) for a, b in zip(old, new, strict=True))
    return False


def compare(row: Mapping, items: Sequence[Mapping], pipeline: Pipeline, eps_conf: float, eps_px: float) -> str:
    """The verdict on a recomputed output. Both hashes are of the floats themselves, so that one doesn't follow from the other."""
    fine, coarse = map(_sha, _row_texts(pipeline.task, items))
    if coarse == row["decision_sha256"]:
        return "verified_exact" if fine == row["jcs_sha256"] and row["runtime"] == pipeline.runtime else "verified_decision"
    sealed = json.loads(row["sealed_fine"]) if row["sealed_fine"] is not None and _sha(row["sealed_fine"]) == row["jcs_sha256"] else {}
    return "boundary_flip" if near_tie(sealed, items, eps_conf, eps_px) else "output_mismatch"


RESULT = "seq long, verdict string, reason string"
#: Inputs that a pipeline is handed at once.
BATCH = 256


def recompute(records: DataFrame, load: Loader, digest: str | None, eps_conf: float = EPS_CONF, eps_px: float = EPS_PX) -> DataFrame:
    """``seq``, ``verdict`` (of ``VERDICTS``) and ``reason`` (why it was skipped) of every record.

    ``records``: seq, weights (the model's digest as sealed), source_kind,
    input_sha256, jcs_sha256, decision_sha256, runtime, data (the input's bytes or
    null), sealed_fine (the stored decisions or null). ``digest``: that of the
    model at hand. ``load`` is called once in each task.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pipeline = load()
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).to_dict("records")
            for part in (rows[i : i + BATCH] for i in range(0, len(rows), BATCH)):
                out, ready = [], []
                for r in part:
                    if digest is None:
                        out.append((r["seq"], "skipped", "no digest of the model"))
                    elif r["weights"] != digest:
                        out.append((r["seq"], "model_swap", None))
                    elif r["data"] is None:
                        out.append((r["seq"], "skipped", "no input"))
                    else:
                        prepared = pipeline.prepare(bytes(r["data"]), r["source_kind"])
                        try:
                            seen = bytes(r["data"]) if r["source_kind"] == "encoded_file" else pipeline.tensor_bytes(prepared)
                        except NotImplementedError:
                            out.append((r["seq"], "skipped", "the pipeline can't tell its tensor's bytes"))
                            continue
                        if hashlib.sha256(seen).hexdigest() != r["input_sha256"]:
                            out.append((r["seq"], "input_swap", None))
                        else:
                            ready.append((r, prepared))
                if ready:
                    for (r, _), raw in zip(ready, pipeline.infer([p for _, p in ready]), strict=True):
                        out.append((r["seq"], compare(r, pipeline.decode(raw), pipeline, eps_conf, eps_px), None))
                yield pd.DataFrame(out, columns=["seq", "verdict", "reason"])

    columns = ("seq", "weights", "source_kind", "input_sha256", "jcs_sha256", "decision_sha256", "runtime", "data", "sealed_fine")
    return records.select(*columns).mapInPandas(run, RESULT)


def tally(results: DataFrame) -> DataFrame:
    """Records by verdict, and skipped ones by reason."""
    return results.groupBy("verdict", "reason").agg(F.count("*").alias("n"))


def seal_outputs(inputs: DataFrame, load: Loader) -> DataFrame:
    """What a field pipeline would seal: ``seq``, ``fine`` and ``coarse`` of every input (seq, source_kind, data)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pipeline = load()
        for batch in batches:
            for part in (batch.iloc[i : i + BATCH] for i in range(0, len(batch), BATCH)):
                prepared = [pipeline.prepare(bytes(d), k) for d, k in zip(part["data"], part["source_kind"], strict=True)]
                texts = [_row_texts(pipeline.task, pipeline.decode(raw)) for raw in pipeline.infer(prepared)]
                yield pd.DataFrame({"seq": part["seq"], "fine": [t[0] for t in texts], "coarse": [t[1] for t in texts]})

    return inputs.select("seq", "source_kind", "data").mapInPandas(run, "seq long, fine string, coarse string")
