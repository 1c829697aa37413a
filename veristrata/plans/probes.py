"""Registered queries of recomputed inferences, sealed output forms, canonical numbers and control regions."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import canonical
from veristrata.operators import recompute
from veristrata.plans import inputs
from veristrata.plans.queries import query
from veristrata.sources.session import cut, table

#: Records of ``embeddings`` that are changed after they were sealed, by number; the first that holds tells.
SWAPPED, MISSING, REPLACED, ALTERED, ELSEWHERE = "vec_id % 83 = 3", "vec_id % 79 = 2", "vec_id % 89 = 7", "vec_id % 97 = 5", "vec_id % 5 = 1"


class Centres:
    """A linear classifier as a plug-in: the class whose centre is nearest, with softmax confidences of the three best."""

    runtime, task = "numpy float64", "classify"

    def __init__(self, classes: list[int], centres: np.ndarray):
        self.classes, self.centres = classes, centres
        self.bias = (centres**2).sum(1) / 2

    def prepare(self, data: bytes, kind: str) -> np.ndarray:
        return np.frombuffer(data, ">f8")

    def tensor_bytes(self, prepared: np.ndarray) -> bytes:
        return prepared.astype(">f8").tobytes()

    def infer(self, prepared):
        # one row at a time: sums mustn't depend on what else is in a batch
        return [self.centres @ x - self.bias for x in prepared]

    def decode(self, raw) -> list[dict]:
        p = np.exp(raw - raw.max())
        p /= p.sum()
        return [{"cls": self.classes[i], "conf": float(p[i])} for i in sorted(range(len(p)), key=lambda i: (-p[i], self.classes[i]))[:3]]


def fitted(vectors: DataFrame) -> tuple[list[int], np.ndarray, str]:
    """Classes, their centres (a row a class comes to the driver) and the model's digest. ``vectors``: label, vector."""
    each = vectors.select("label", F.posexplode("vector").alias("d", "x")).groupBy("label", "d").agg(F.round(F.avg("x"), 6).alias("m"))
    rows = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("m")).orderBy("label").collect()
    centres = np.array([r["m"] for r in rows])
    return [r["label"] for r in rows], centres, hashlib.sha256(centres.astype(">f8").tobytes()).hexdigest()


def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as sealed inferences of a classifier, some of them changed, and what recomputing each shows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    classes, centres, digest = fitted(vectors)
    load = lambda: Centres(classes, centres)

    @F.pandas_udf("binary")
    def packed(v):
        import pandas as pd

        return pd.Series([np.asarray(x, ">f8").tobytes() for x in v])

    stored = cut(vectors.select(F.col("vec_id").alias("seq"), packed("vector").alias("data"), F.when(F.expr("vec_id % 2 = 0"), "encoded_file").otherwise("model_input_tensor").alias("source_kind")))
    sealed = cut(recompute.seal_outputs(stored, load))
    rows = stored.join(sealed, "seq").withColumn("vec_id", F.col("seq"))
    changed = F.concat(F.lit('{"task":"classify","top":[{"cls":-1,"conf_e6":999999}]}'))
    altered = F.expr(ALTERED)
    fine = F.when(altered, changed).otherwise(F.col("fine"))
    coarse = F.when(altered, F.lit('{"task":"classify","top":[{"cls":-1}]}')).otherwise(F.col("coarse"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    records = rows.select(
        "seq", F.when(F.expr(SWAPPED), "00").otherwise(digest).alias("weights"), "source_kind", sha(F.when(F.expr(REPLACED), F.lit("another")).otherwise(F.col("data")).cast("binary")).alias("input_sha256"),
        sha(fine).alias("jcs_sha256"), sha(coarse).alias("decision_sha256"), F.when(F.expr(ELSEWHERE), "another runtime").otherwise(Centres.runtime).alias("runtime"), F.when(~F.expr(MISSING), F.col("data")).alias("data"), fine.alias("sealed_fine"),
    )
    return recompute.recompute(records, load, digest)


_VERDICT = f"case when {SWAPPED} then 'model_swap' when {MISSING} then 'skipped' when {REPLACED} then 'input_swap' when {ALTERED} then 'output_mismatch' when {ELSEWHERE} then 'verified_decision' else 'verified_exact' end"


@query("M13_recompute", f"select vec_id seq, {_VERDICT} verdict, case when {_VERDICT} = 'skipped' then 'no input' end reason from embeddings")
def recompute_all(spark, sf_dir):
    return recomputed(spark, sf_dir)


@query("A60_recompute_tally", f"select {_VERDICT} verdict, case when {_VERDICT} = 'skipped' then 'no input' end reason, count(*) n from embeddings group by all")
def recompute_tally(spark, sf_dir):
    return recompute.tally(recomputed(spark, sf_dir))


_ITEMS = f"b as ({inputs.BOXES_SQL}), i as (select sample_id, list({{'cls': det_id, 'conf': y / 12, 'box': [x, y / 3, x + w, y + h]}} order by det_id, x, y, w) items from b group by sample_id)"
_JOIN = "array_to_string(list_transform({0}, lambda v: floor(v * {1} + 0.5)::bigint::varchar), ',')"


@query(
    "F26_output_forms",
    f"with {_ITEMS} select sample_id, sha256('{{\"detections\":[' || array_to_string(list_transform(items, lambda d: '{{\"box_q64\":[' || {_JOIN.format('d.box', 64)} || '],\"cls\":' || d.cls || ',\"conf_e6\":' || greatest(0, least(1000000, floor(d.conf * 1000000 + 0.5)))::bigint || '}}'), ',') || '],\"filter\":{{\"conf_thr_e6\":250000,\"nms_iou_e6\":500000}},\"task\":\"detect\"}}') fine_sha256, "
    f"sha256('{{\"detections\":[' || array_to_string(list_transform(list_sort(list_transform(items, lambda d: {{'c': d.cls, 'p': list_transform(d.box, lambda v: floor(v + 0.5)::bigint)}})), lambda d: '{{\"box_px\":[' || array_to_string(list_transform(d.p, lambda v: v::varchar), ',') || '],\"cls\":' || d.c || '}}'), ',') || '],\"filter\":{{\"conf_thr_e6\":250000,\"nms_iou_e6\":500000}},\"task\":\"detect\"}}') coarse_sha256 from i",
)
def output_forms(spark, sf_dir):
    b = inputs.boxes(spark, sf_dir)
    one = F.struct(F.col("det_id").alias("cls"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    items = F.transform(F.array_sort(F.collect_list(one)), lambda d: F.struct(d["cls"].cast("int").alias("cls"), (d["y"] / 12).alias("conf"), F.array(d["x"], d["y"] / 3, d["x"] + d["w"], d["y"] + d["h"]).alias("box")))
    g = b.groupBy("sample_id").agg(items.alias("items"))  # the boxes of one image
    text = lambda form: F.sha2(recompute.output_text(F.lit("detect"), F.col("items"), form, F.lit(0.25), F.lit(0.5)).cast("binary"), 256)
    return g.select("sample_id", text("fine").alias("fine_sha256"), text("coarse").alias("coarse_sha256"))


@query("F25_canonical_numbers", "select x, case when x = floor(x) then x::bigint::varchar else x::varchar end as text from (select distinct l_extendedprice * l_discount / 7 x from lineitem) where x = 0 or x > 0.001")
def canonical_numbers(spark, sf_dir):
    x = (F.col("l_extendedprice") * F.col("l_discount") / 7).alias("x")
    return table(spark, sf_dir, "lineitem").select(x).distinct().where("x = 0 or x > 0.001").select("x", canonical.number_text(F.col("x")).alias("text"))


@query(
    "O07_control_regions",
    "with r as (select p_partkey, p_size % 6 r0, p_partkey % 5 c0, p_size % 6 + 2 r1, p_partkey % 5 + 1 + p_size % 2 c1 from part), g as (select unnest(range(8)) v), "
    "a as (select p_partkey, x.v r, y.v c, r1 - r0 h, c1 - c0 w from r, g x, g y where x.v + r1 - r0 <= 8 and y.v + c1 - c0 <= 8 and (x.v + r1 - r0 <= r0 or x.v >= r1 or y.v + c1 - c0 <= c0 or y.v >= c1)), "
    "k as (select *, row_number() over (partition by p_partkey order by md5(p_partkey || ':' || r || ':' || c), r, c) n from a) select p_partkey, list([r, c, r + h, c + w] order by r, c) regions from k where n <= 5 group by p_partkey",
)
def control_regions(spark, sf_dir):
    p, s, k = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey")
    region = F.array(*(x.cast("int") for x in (s % 6, k % 5, s % 6 + 2, k % 5 + 1 + s % 2)))
    return p.select("p_partkey", recompute.control_regions(region, 8, 5, k).alias("regions"))
