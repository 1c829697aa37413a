"""Integrity-assurance inputs stated over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.sources.session import table

FINDINGS_SQL = """
select substr(sha256(concat_ws(chr(31), detector_id, 'sample', target_ref, attack_class)), 1, 16) finding_id, * from (
  select cast(doc_id as varchar) target_ref, 'sample' target_type, 'scan-' || (doc_id % 5) scan_id, source contributor, lang batch, 'statistical' nature,
    case doc_id % 3 when 0 then 'copies.text' when 1 then 'label.quality' else 'drift.length' end detector_id,
    case doc_id % 3 when 0 then 'copies_near' when 1 then 'label_error' else 'drift_shift' end attack_class,
    case when n_chars >= 5000 then 'high' when n_chars >= 2500 then 'medium' when n_chars >= 1000 then 'low' else 'info' end severity,
    (doc_id % 101) / 100.0e0 confidence, n_chars / 1000.0e0 score, doc_id % 2 = 0 calibrated,
    case when doc_id % 17 = 0 then 'error' when doc_id % 13 = 0 then 'unavailable' else 'ran' end availability
  from documents)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding a document, of three detectors, from id and length alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    third = F.col("doc_id") % 3
    rows = d.select(
        F.col("doc_id").cast("string").alias("target_ref"), F.lit("sample").alias("target_type"), F.concat(F.lit("scan-"), (F.col("doc_id") % 5).cast("string")).alias("scan_id"),
        F.col("source").alias("contributor"), F.col("lang").alias("batch"), F.lit("statistical").alias("nature"),
        F.when(third == 0, "copies.text").when(third == 1, "label.quality").otherwise("drift.length").alias("detector_id"),
        F.when(third == 0, "copies_near").when(third == 1, "label_error").otherwise("drift_shift").alias("attack_class"),
        F.when(F.col("n_chars") >= 5000, "high").when(F.col("n_chars") >= 2500, "medium").when(F.col("n_chars") >= 1000, "low").otherwise("info").alias("severity"),
        ((F.col("doc_id") % 101) / 100.0).alias("confidence"), (F.col("n_chars") / 1000.0).alias("score"), (F.col("doc_id") % 2 == 0).alias("calibrated"),
        F.when(F.col("doc_id") % 17 == 0, "error").when(F.col("doc_id") % 13 == 0, "unavailable").otherwise("ran").alias("availability"),
    )
    return rows.withColumn("finding_id", F.left(F.sha2(F.concat_ws("\x1f", "detector_id", "target_type", "target_ref", "attack_class").cast("binary"), 256), F.lit(16)))


LEDGER_SQL = """
select event_id seq, event_type, user_id, cast(user_id % 7 as varchar) model_id, ts created_at, cast(user_id % 50 as varchar) || ':' || cast(event_id % 40 as varchar) nonce,
  case when event_id % 97 = 96 then 'anchor_event' when event_id % 41 = 0 then 'model_registration' when event_id % 5 = 0 then 'scan_record' when event_id % 3 = 0 then 'analyst_event' else 'inference' end as type,
  concat_ws('|', cast(event_id as varchar), event_type, cast(user_id as varchar), props) rec
from events"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as a ledger, in the order of event_id."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    kind = F.when(i % 97 == 96, "anchor_event").when(i % 41 == 0, "model_registration").when(i % 5 == 0, "scan_record").when(i % 3 == 0, "analyst_event").otherwise("inference")
    return e.select(i.alias("seq"), "event_type", "user_id", (u % 7).cast("string").alias("model_id"), F.col("ts").alias("created_at"), F.concat((u % 50).cast("string"), F.lit(":"), (i % 40).cast("string")).alias("nonce"), kind.alias("type"), F.concat_ws("|", i.cast("string"), "event_type", u.cast("string"), "props").alias("rec"))


AXES_SQL = """
select unnest(['price', 'quantity', 'discount']) axis, case when l_orderkey % 2 = 0 then 0 else 1 end batch,
  unnest([l_extendedprice, l_quantity + case when l_orderkey % 2 = 1 then 3 else 0 end, l_discount]) as value
from lineitem"""


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of ``lineitem`` by order number, on three axes; quantities of the second half are shifted by 3."""
    from veristrata.operators.drift import as_axes

    half = (F.col("l_orderkey") % 2).cast("int")
    return as_axes(table(spark, sf_dir, "lineitem"), {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity") + F.when(half == 1, 3).otherwise(0), "discount": F.col("l_discount")}, half)


SUBJECTS_SQL = """
select cast(o_orderkey as varchar) model_id, o_orderpriority family, o_orderstatus = 'F' attacked, round(o_totalprice / 1000) as score, o_custkey % 10 as setting, o_orderstatus <> 'O' right_a, o_totalprice > 150000 right_b, 'd' || (o_custkey % 4) detector_id, o_totalprice > 200000 fired
from orders"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` read as evaluated subjects."""
    o = table(spark, sf_dir, "orders")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").cast("string").alias("model_id"), F.col("o_orderpriority").alias("family"), (status == "F").alias("attacked"), F.round(price / 1000).alias("score"), (F.col("o_custkey") % 10).alias("setting"), (status != "O").alias("right_a"), (price > 150000).alias("right_b"), F.concat(F.lit("d"), (F.col("o_custkey") % 4).cast("string")).alias("detector_id"), (price > 200000).alias("fired"))


PREDICTIONS_SQL = "select 'c' || (l_suppkey % 10) contributor, l_returnflag as label, case when l_suppkey % 10 = 3 and l_linenumber > 3 and l_returnflag = 'A' then 'N' when l_partkey % 11 = 0 then 'R' else l_returnflag end predicted from lineitem"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` read as labelled samples with predictions; contributor c3 mislabels part of class A."""
    l, s = table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 10
    flag = F.col("l_returnflag")
    return l.select(F.concat(F.lit("c"), s.cast("string")).alias("contributor"), flag.alias("label"), F.when((s == 3) & (F.col("l_linenumber") > 3) & (flag == "A"), "N").when(F.col("l_partkey") % 11 == 0, "R").otherwise(flag).alias("predicted"))


BOXES_SQL = "select cast(l_orderkey as varchar) sample_id, l_linenumber det_id, 'c' || (l_suppkey % 10) contributor, l_returnflag category, l_quantity x, l_discount * 100 y, 1 + l_tax * 1000 w, 1 + l_linenumber * 10.0e0 h from lineitem"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` read as boxes of images (orders)."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_linenumber").alias("det_id"), F.concat(F.lit("c"), (F.col("l_suppkey") % 10).cast("string")).alias("contributor"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (1 + F.col("l_tax") * 1000).alias("w"), (1 + F.col("l_linenumber") * 10.0).alias("h"))
