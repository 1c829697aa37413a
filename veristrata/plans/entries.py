"""Registered queries of the small operators in ``operators/reading.py`` and of others that had no entry of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.functions import scalars, stats
from veristrata.operators import cohorts, evaluation, governance, ledger, models, reading, resampling, risk, similarity
from veristrata.plans import inputs
from veristrata.plans.queries import _LEDGER, _RANK, ROUTED_SQL, _routed, query
from veristrata.sources.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _ledger(spark, sf_dir):
    return inputs.ledger(spark, sf_dir)


# ---- filters and rules ----


@query("P10_budget_filter", "select p_partkey detector_id, case when p_size % 10 = 0 then 'disabled' when p_brand not in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') then 'capability' when p_size % 3 = 0 then 'no_model' when p_size % 4 > 2 then 'tier' end reason from part")
def budget_filter(spark, sf_dir):
    s = F.col("p_size")
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("detector_id"), (s % 10 == 0).alias("disabled"), F.array("p_brand").alias("requires"), (s % 3 == 0).alias("needs_model"), (s % 4).alias("tier"))
    return c.select("detector_id", reading.excluded_by(["Brand#11", "Brand#12", "Brand#13", "Brand#21"], 2, False).alias("reason"))


@query("P14_uncalibrated_cap", f"with {ROUTED_SQL} select finding_id, disposition from routed where not calibrated")
def uncalibrated_cap(spark, sf_dir):
    return _routed(spark, sf_dir).where("not calibrated").select("finding_id", "disposition")


@query("P16_contributor_disposition", "with g as (select source, count(*) n, count(*) filter (n_chars > 2500) k from documents group by source), r as (select source, n, k, k / n as mean, (sum(k) over ()) / (sum(n) over ()) prior, 1.959963984540054 z from g), w as (select *, (mean + z * z / (2 * n)) / (1 + z * z / n) mid, z / (1 + z * z / n) * sqrt(mean * (1 - mean) / n + z * z / (4.0e0 * n * n)) half from r) select source, mean, case when greatest(0, least(mid - half, mean)) > prior then case when mean >= 0.25 then 'quarantine' else 'review' end else 'accept' end disposition from w")
def contributor_disposition(spark, sf_dir):
    """Sources by the interval of their share of long documents against the share of all."""
    counts = cohorts.share_against_rest(_docs(spark, sf_dir), "source", F.col("n_chars") > 2500)
    all_n, all_k = counts.agg(F.sum("n"), F.sum("k")).first()
    low = evaluation.wilson_columns(F.col("k").cast("double"), F.col("n").cast("double"))[0]
    return counts.select("source", F.col("share").alias("mean"), risk.contributor_disposition(low, F.lit((all_k or 0) / max(1, all_n or 0)), F.col("share")).alias("disposition"))


@query("P18_severity_by_size", "select n_chars, count(*) n, case when count(*) >= 10 then 'high' when count(*) >= 3 then 'medium' else 'low' end severity from documents group by n_chars having count(*) > 1")
def severity_by_size(spark, sf_dir):
    g = _docs(spark, sf_dir).groupBy("n_chars").agg(F.count("*").alias("n")).where("n > 1")
    return g.withColumn("severity", similarity.severity_by_size(F.col("n")))


@query("P27_report_filters", f"with {ROUTED_SQL} select finding_id, disposition, confidence from (select *, {_RANK} r from routed where disposition = 'accept' and nature = 'statistical' and availability = 'ran' and detector_id like 'label.%') order by r desc, confidence desc, finding_id limit 40")
def report_filters(spark, sf_dir):
    return governance.page_of_findings(_routed(spark, sf_dir), 40, disposition="accept", nature="statistical", availability="ran", module="label").select("finding_id", "disposition", "confidence")


@query("P28_ledger_filter", f"with {_LEDGER} select seq, type, model_id from l where type in ('scan_record', 'model_registration') and seq > 100")
def ledger_filter(spark, sf_dir):
    return reading.read_ledger(_ledger(spark, sf_dir), ("scan_record", "model_registration"), 100).select("seq", "type", "model_id")


@query("P29_cost_estimates", "select p_partkey detector_id, case when p_size % 3 > 0 then round(p_size * 1000 / 16.84e0, 1) end as \"seconds\" from part")
def cost_estimates(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("detector_id"), reading.estimated_seconds(F.col("p_size") * 1000, F.col("p_size") % 3 > 0).alias("seconds"))


# ---- joins ----


@query("J05_images_annotations", "select o_orderkey image_id, count(l_orderkey) n_boxes, round(coalesce(sum(l_quantity), 0), 2) area from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def images_annotations(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    boxes = l.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))  # combined before they meet the images
    return o.join(boxes, o["o_orderkey"] == boxes["l_orderkey"], "left").select(F.col("o_orderkey").alias("image_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_boxes"), F.round(F.coalesce("q", F.lit(0.0)), 2).alias("area"))


@query("J15_payload_state", "with r as (select event_id seq, case when event_id % 9 > 0 then sha256('p' || (event_id % 500)) end payload_sha256 from events), p as (select distinct sha256('p' || doc_id) sha256 from documents) select seq, case when payload_sha256 is null then 'none' when sha256 is null then 'missing' else 'held' end state from r left join p on payload_sha256 = sha256")
def payload_state(spark, sf_dir):
    i = F.col("event_id")
    h = lambda x: F.sha2(F.concat(F.lit("p"), x.cast("string")).cast("binary"), 256)
    records = table(spark, sf_dir, "events").select(i.alias("seq"), F.when(i % 9 > 0, h(i % 500)).alias("payload_sha256"))
    return reading.payload_state(records, _docs(spark, sf_dir).select(h(F.col("doc_id")).alias("sha256"))).select("seq", "state")


@query("J16_input_state", "with r as (select doc_id ref, sha256(case when doc_id % 10 = 0 then 'other' else coalesce(text, '') end) sha256 from documents), i as (select doc_id ref, sha256(coalesce(text, '')) now from documents where doc_id % 7 > 0) select r.ref, case when now is null then 'missing' when now = sha256 then 'same' else 'swapped' end state from r left join i using (ref)")
def input_state(spark, sf_dir):
    d, text = _docs(spark, sf_dir), F.coalesce("text", F.lit(""))
    records = d.select(F.col("doc_id").alias("ref"), F.sha2(F.when(F.col("doc_id") % 10 == 0, "other").otherwise(text).cast("binary"), 256).alias("sha256"))
    return reading.input_state(records, d.where("doc_id % 7 > 0").select(F.col("doc_id").alias("ref"), text.alias("content"))).select("ref", "state")


_TAXONOMY = [("copies_near", "data", "poisoning"), ("drift_shift", "drift", "shift")]


@query("J22_taxonomy", f"with f as ({inputs.FINDINGS_SQL}), t(attack_class, module, kind) as (values ('copies_near', 'data', 'poisoning'), ('drift_shift', 'drift', 'shift')) select finding_id, coalesce(module, 'unknown') module, coalesce(kind, 'unknown') kind from f left join t using (attack_class)")
def taxonomy(spark, sf_dir):
    t = spark.createDataFrame(_TAXONOMY, "attack_class string, module string, kind string")
    return reading.with_taxonomy(inputs.findings(spark, sf_dir), t).select("finding_id", "module", "kind")


@query("J23_scans_changed", "select coalesce(a.scan_id, b.scan_id) scan_id, case when b.scan_id is null then 'deleted' else 'new' end change from (select distinct o_custkey scan_id from orders where o_orderstatus = 'F') a full join (select distinct o_custkey scan_id from orders where o_orderstatus = 'O') b using (scan_id) where a.scan_id is null or b.scan_id is null")
def scans_changed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "scan_id")
    return reading.scans_changed(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'").select("scan_id").distinct())


# ---- counts ----


@query("A64_distinct_operators", f"with f as ({inputs.FINDINGS_SQL}) select scan_id, list_sort(list(distinct detector_id)) detectors, list_sort(list(distinct batch)) batches from f group by scan_id")
def distinct_operators(spark, sf_dir):
    return inputs.findings(spark, sf_dir).groupBy("scan_id").agg(F.sort_array(F.collect_set("detector_id")).alias("detectors"), F.sort_array(F.collect_set("batch")).alias("batches"))


@query("A70_effective_counts", f"with {ROUTED_SQL} select disposition, count(*) n, count(*) filter (severity = 'low') pending from routed group by disposition")
def effective_counts(spark, sf_dir):
    states = _routed(spark, sf_dir).select("disposition", F.when(F.col("severity") == "low", "accept").alias("pending_disposition"))
    return governance.effective_counts(states)


@query("A46_required_n", "with p as (select distinct p_size / 100.0e0 p1, p_size / 100.0e0 + 0.1 p2 from part), z as (select p1, p2, 1.959963984540054 * sqrt(2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2)) + 0.8416212335729143 * sqrt(p1 * (1 - p1) + p2 * (1 - p2)) s from p) select p1, ceil(s * s / ((p1 - p2) * (p1 - p2)))::bigint n from z")
def required_n(spark, sf_dir):
    @F.pandas_udf("long")
    def needed(p1, p2):
        import pandas as pd

        return pd.Series([stats.required_n(a, b) for a, b in zip(p1, p2, strict=True)])

    p = table(spark, sf_dir, "part").select((F.col("p_size") / 100.0).alias("p1")).distinct()
    return p.select("p1", needed("p1", F.col("p1") + 0.1).alias("n"))


@query("A06_permutation")
def permutation(spark, sf_dir):
    """Does the share of long documents differ between sources? Tests hold it against shuffled flags."""
    return resampling.permutation_test(_docs(spark, sf_dir).withColumn("long", F.col("n_chars") > 2000), "source", "long")


@query("A45_bootstrap_rate")
def bootstrap_rate(spark, sf_dir):
    """Share of rows returned by supplier, with percentile intervals; tests hold them against resampled rows."""
    return resampling.bootstrap_rates(table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R"), "l_suppkey", "returned")


@query("A48_bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    """Percentile interval of the area under the curve by family; tests hold it against resampled rows."""
    return resampling.bootstrap_auroc(inputs.subjects(spark, sf_dir).select("family", "score", "attacked"), "family", draws=500)


_AREA = "select {0} part, (sum(case when attacked then r end) - count(*) filter (attacked) * (count(*) filter (attacked) + 1) / 2) / (count(*) filter (attacked) * count(*) filter (not attacked))::double a from (select attacked, rank() over (order by {1}) + (count(*) over (partition by {1}) - 1) / 2 r from s)"


@query("A52_ablation", f"with s as ({inputs.SUBJECTS_SQL}), p as (" + " union all ".join(_AREA.format(n, e) for n, e in (("'all'", "score + setting"), ("'score'", "setting"), ("'setting'", "score"))) + "), w as (select a from p where part = 'all') select part, round(p.a, 9) auroc, round(w.a - p.a, 9) loss, case when w.a - p.a > 0.01 then 'helps' when w.a - p.a < -0.01 then 'hurts' else 'no difference' end verdict from p, w where part <> 'all'")
def ablation(spark, sf_dir):
    """What the area loses with each part of a score taken away."""
    s = inputs.subjects(spark, sf_dir)
    area = lambda part, score: evaluation.auroc(s.select(score.cast("double").alias("score"), "attacked")).select(F.lit(part).alias("part"), "auroc")
    score, setting = F.col("score"), F.col("setting")
    out = evaluation.ablation(area("all", score + setting), area("score", setting).unionByName(area("setting", score)))
    return out.withColumn("auroc", F.round("auroc", 9)).withColumn("loss", F.round("loss", 9))


# ---- windows ----


@query("W01_gaps", "select event_id, round((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6, 3) gap from events")
def gaps(spark, sf_dir):
    return reading.gaps(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "gap")


@query("W08_ecdf", "select distinct l_returnflag, l_quantity, cume_dist() over (partition by l_returnflag order by l_quantity) ecdf from lineitem")
def ecdf(spark, sf_dir):
    return reading.shares(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").select("l_returnflag", "l_quantity", "ecdf")


@query("W09_average_ranks", "with r as (select lang, n_chars, rank() over (partition by lang order by n_chars) r, count(*) over (partition by lang, n_chars) n from documents where n_chars is not null) select distinct lang, n_chars, n, r + (n - 1) / 2 mean_rank from r")
def average_ranks(spark, sf_dir):
    return reading.shares(_docs(spark, sf_dir), "lang", "n_chars").select("lang", "n_chars", "n", "mean_rank")


@query("W10_top_of_each", "select lang, doc_id, place::int place from (select lang, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) place from documents) where place <= 5")
def top_of_each(spark, sf_dir):
    return reading.top_by(_docs(spark, sf_dir), "lang", [F.desc("n_chars"), F.col("doc_id")], 5).select("lang", "doc_id", "place")


@query("W11_group_ranking", "select source, n, (row_number() over (order by n desc, source))::int place from (select source, count(*) n from documents group by source)")
def group_ranking(spark, sf_dir):
    g = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    return reading.top_by(g, "all", [F.desc("n"), F.col("source")], 1 << 30).select("source", "n", "place")


@query("W12_majority", "with n as (select source, lang, count(*) n from documents group by all), r as (select *, row_number() over (partition by source order by n desc, lang) k, max(n) over (partition by source) top from n) select source, max(lang) filter (k = 1) \"value\", max(n) n, count(*) filter (n = top) = 1 strict from r group by source")
def majority(spark, sf_dir):
    return reading.majority(_docs(spark, sf_dir), "source", "lang")


@query("W13_last_scan_record", f"with {_LEDGER} select model_id, max(seq) seq, arg_max(rec, seq) rec from l where type = 'scan_record' group by model_id")
def last_scan_record(spark, sf_dir):
    return reading.last_of(_ledger(spark, sf_dir), "model_id", "scan_record")


@query("W15_checkpoint_cadence", f"with {_LEDGER} select seq, type from l where seq % 64 = 63 and type <> 'anchor_event'")
def checkpoint_cadence(spark, sf_dir):
    return reading.cadence(_ledger(spark, sf_dir), 64, "anchor_event")


# ---- order and samples ----


@query("O02_scans_newest_first", "select o_orderkey scan_id, row_number() over (order by o_orderdate desc, o_orderkey desc) place from orders")
def scans_newest_first(spark, sf_dir):
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("created_at"))
    return governance.scans_newest_first(scans).select("scan_id", "place")


@query("O04_evidence_caps", f"with f as ({inputs.FINDINGS_SQL}) select scan_id, finding_id, place::int place from (select scan_id, finding_id, row_number() over (partition by scan_id order by confidence desc, finding_id) place from f) where place <= 20")
def evidence_caps(spark, sf_dir):
    return reading.top_by(inputs.findings(spark, sf_dir), "scan_id", [F.desc("confidence"), F.col("finding_id")], 20).select("scan_id", "finding_id", "place")


@query("O05_top_classes", f"with p as ({inputs.PREDICTIONS_SQL}), n as (select label, count(*) n from p group by all), r as (select label, predicted, count(*) / any_value(n) r from p join n using (label) where label <> predicted group by all), i as (select predicted c, sum(r) x from r group by all), o as (select label c, sum(r) x from r group by all) select n.label as class, round(coalesce(i.x, 0) - coalesce(o.x, 0), 9) suspicion from n left join i on i.c = n.label left join o on o.c = n.label order by coalesce(i.x, 0) - coalesce(o.x, 0) desc, class limit 2")
def top_classes(spark, sf_dir):
    """The two classes that draw most predictions from others."""
    top = models.top_suspects(models.confusion_asymmetry(inputs.predictions(spark, sf_dir)), 2)
    return top.select(F.col("label").alias("class"), F.round("asymmetry", 9).alias("suspicion"))


@query("O06_seeded_sample", "select event_id, event_id % 50 = 0 flagged from events order by flagged desc, md5(event_id || ':s1'), event_id limit 500")
def seeded_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 50 == 0).alias("flagged"))
    return reading.seeded_sample(e, "event_id", "s1", 500, F.col("flagged"))


@query("O08_canonical_keys", """select event_id, '{"event_type":"' || event_type || '","seq":' || event_id || ',"user_id":' || user_id || '}' canonical from events""")
def canonical_keys(spark, sf_dir):
    fields = {"user_id": F.col("user_id").cast("string"), "event_type": F.concat(F.lit('"'), "event_type", F.lit('"')), "seq": F.col("event_id").cast("string")}
    return table(spark, sf_dir, "events").select("event_id", reading.canonical(fields).alias("canonical"))


# ---- sets ----

_CAPS = ("images", "labels", "Brand#11")


@query("U01_capability_union", "select p_partkey, list_sort(list_distinct([p_brand, p_type] || ['images', 'labels', 'Brand#11'])) capabilities from part")
def capability_union(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.sort_array(F.array_union(F.array("p_brand", "p_type"), F.array(*map(F.lit, _CAPS)))).alias("capabilities"))


@query("U02_capability_difference", "select p_partkey, list_sort(list_filter(list_distinct([p_brand, p_type, 'labels']), lambda x: x not in ('images', 'labels', 'Brand#11'))) missing from part")
def capability_difference(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.sort_array(F.array_except(F.array(F.col("p_brand"), F.col("p_type"), F.lit("labels")), F.array(*map(F.lit, _CAPS)))).alias("missing"))


_SIDES = "a as (select distinct p_type v from part where p_size <= 25), b as (select distinct p_type v from part where p_size > 25 and p_brand <> 'Brand#13')"


@query("U03_axis_sets", f"with {_SIDES} select v as axis, case when b.v is null then 'left' when a.v is null then 'right' else 'both' end stands from a full join b using (v)")
def axis_sets(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_type", "axis")
    return reading.compared(p.where("p_size <= 25"), p.where("p_size > 25 and p_brand <> 'Brand#13'"), "axis")


@query("U04_coverage_minus", "select distinct source || ':' || lang covered from documents where n_chars < 4000 except select distinct source || ':' || lang from documents where n_chars >= 4000")
def coverage_minus(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.concat("source", F.lit(":"), "lang").alias("covered"), "n_chars")
    return d.where("n_chars < 4000").select("covered").subtract(d.where("n_chars >= 4000").select("covered"))


@query("U05_coverage_compare", "select coalesce(a.c, b.c) covered, case when b.c is null then 'left' when a.c is null then 'right' else 'both' end stands from (select distinct o_custkey c from orders where o_orderpriority = '1-URGENT') a full join (select distinct o_custkey c from orders where o_orderpriority = '5-LOW') b using (c)")
def coverage_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "covered")
    return reading.compared(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), "covered")


@query("U06_all_findings", f"with f as ({inputs.FINDINGS_SQL}) select finding_id, detector_id, null::varchar note from f union all select sha256('m' || p_partkey), 'model.probe', p_type from part")
def all_findings(spark, sf_dir):
    f = inputs.findings(spark, sf_dir).select("finding_id", "detector_id")
    m = table(spark, sf_dir, "part").select(F.sha2(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).cast("binary"), 256).alias("finding_id"), F.lit("model.probe").alias("detector_id"), F.col("p_type").alias("note"))
    return f.unionByName(m, allowMissingColumns=True)


@query("U07_unknown_ids", "select distinct o_custkey + 100 c_custkey from orders where o_custkey + 100 not in (select c_custkey from customer)")
def unknown_ids(spark, sf_dir):
    given = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("c_custkey"))
    return reading.unknown_ids(table(spark, sf_dir, "customer"), given, "c_custkey")


# ---- functions ----


@query("F03_cache_keys", "select doc_id, sha256(unhex(hex(sha256(coalesce(text, '')))) || '\\x00'::blob || lang::blob || '\\x00'::blob || '1'::blob || '\\x00'::blob) as \"key\" from documents")
def cache_keys(spark, sf_dir):
    content = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return _docs(spark, sf_dir).select("doc_id", scalars.cache_key(content, F.col("lang"), F.lit("1")).alias("key"))


@query("F04_domain_hashes", f"with {_LEDGER} select seq, sha256('\\x00'::blob || rec::blob) leaf, sha256('\\x02'::blob || rec::blob) link, sha256('\\x01'::blob || unhex(sha256('\\x00'::blob || rec::blob)) || unhex(sha256('\\x02'::blob || rec::blob))) node from l")
def domain_hashes(spark, sf_dir):
    h = _ledger(spark, sf_dir).select("seq", ledger.leaf_hash(F.col("rec")).alias("leaf"), ledger.link_hash(F.col("rec")).alias("link"))
    return h.withColumn("node", ledger.node_hash(F.col("leaf"), F.col("link")))


@query("F07_bits", "select event_id, bit_count(xor(event_id, user_id * 7919))::int distance, ((event_id * 7919) >> 8) & 255 chunk from events")
def bits(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.bit_count(i.bitwiseXOR(u * 7919)).alias("distance"), F.shiftrightunsigned(i * 7919, 8).bitwiseAND(F.lit(255)).alias("chunk"))


_B = f"b as ({inputs.BOXES_SQL})"


@query("F09_iou", f"with {_B}, i as (select a.sample_id, a.det_id, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) n, a.w * a.h s, b.w * b.h t from b a join b on a.sample_id = b.sample_id and b.det_id = a.det_id + 1) select sample_id, det_id, round(n / (s + t - n), 6) iou, round(ln(s / t), 6) log_area from i")
def box_overlap(spark, sf_dir):
    b = inputs.boxes(spark, sf_dir)
    both = b.alias("a").join(b.alias("b"), (F.col("a.sample_id") == F.col("b.sample_id")) & (F.col("b.det_id") == F.col("a.det_id") + 1))
    area = lambda s: F.col(f"{s}.w") * F.col(f"{s}.h")
    return both.select(F.col("a.sample_id").alias("sample_id"), F.col("a.det_id").alias("det_id"), F.round(cohorts.iou("a", "b"), 6).alias("iou"), F.round(F.log(area("a") / area("b")), 6).alias("log_area"))


@query("F10_cosine", "select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 6) cosine, round(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])), 6) norm from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = v.alias("a").join(v.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    norm = F.sqrt(F.aggregate(F.col("a.embedding"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return both.select(F.col("a.vec_id").alias("vec_id"), F.round(similarity.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"), F.round(norm, 6).alias("norm"))


@query("F17_clean_values", "select event_id, left(trim(regexp_replace(case when event_id % 3 = 0 then chr(7) || event_type || chr(8238) || '  ' else ' ' || event_type || repeat('x', (event_id % 200)::int) end, '[\\p{Cc}\\p{Cf}]', '_', 'g')), 128) as \"value\" from events")
def clean_values(spark, sf_dir):
    i, t = F.col("event_id"), F.col("event_type")
    raw = F.when(i % 3 == 0, F.concat(F.lit("\x07"), t, F.lit("‮  "))).otherwise(F.concat(F.lit(" "), t, F.expr("repeat('x', cast(event_id % 200 as int))")))
    return table(spark, sf_dir, "events").select("event_id", reading.clean_value(raw).alias("value"))


@query("F18_reasons", "select n_chars, printf('%d copies of %d characters', count(*), n_chars) reason from documents group by n_chars having count(*) > 1")
def reasons(spark, sf_dir):
    g = _docs(spark, sf_dir).groupBy("n_chars").agg(F.count("*").alias("n")).where("n > 1")
    return g.select("n_chars", F.format_string("%d copies of %d characters", "n", "n_chars").alias("reason"))


@query("F19_encoders", "select p_partkey, regexp_matches(lower(case when p_size % 7 = 0 then 'made by Pillow 9' when p_size % 5 = 0 then 'GIMP' || p_size end), 'pillow|imagemagick|ffmpeg|opencv|libjpeg|gd-jpeg') is true named from part")
def encoders(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.encoder_named(F.when(s % 7 == 0, "made by Pillow 9").when(s % 5 == 0, F.concat(F.lit("GIMP"), s.cast("string")))).alias("named"))


@query("F21_scan_ids", "select event_id, strftime(ts, 'scan-%Y%m%d-') || lpad((event_id % 1000)::varchar, 3, '0') scan_id from events")
def scan_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("scan-"), F.date_format("ts", "yyyyMMdd"), F.lit("-"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")).alias("scan_id"))


@query("F32_copies_confidence", "with g as (select n_chars, count(*) n from documents group by n_chars having count(*) > 1) select n_chars, round(case when n_chars % 2 = 0 then least(0.95e0, 0.5e0 + 0.45e0 * (0.95e0 + (n_chars % 5) / 100.0e0 - 0.95e0) / (1 - 0.95e0) + least(n, 10) * 0.02e0) else least(0.5e0, 0.3e0 + 0.02e0 * n) end, 9) confidence from g")
def copies_confidence(spark, sf_dir):
    g = _docs(spark, sf_dir).groupBy("n_chars").agg(F.count("*").alias("n")).where("n > 1")
    cosine_ = F.when(F.col("n_chars") % 2 == 0, 0.95 + (F.col("n_chars") % 5) / 100.0)
    return g.select("n_chars", F.round(reading.duplicate_confidence(F.col("n"), cosine_, 0.95), 9).alias("confidence"))
