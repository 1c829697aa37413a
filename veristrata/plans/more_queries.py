"""Further registered queries: contributors and batches, requests, coverage, labels, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.operators import governance, labels, ledger, models, reading, risk
from veristrata.plans import inputs
from veristrata.plans.queries import _LEDGER, _RANK, ROUTED_SQL, _routed, _vectors, query
from veristrata.sources import datasets
from veristrata.sources.session import table


@query("P05_contributors", "with s as (select page_id, case when page_id % 4 = 0 then 'contributor_' || (page_id % 3) || '/x.jpg' else 'x' || page_id || '.jpg' end path, case when page_id % 5 = 0 then 'own' || (page_id % 2) else '' end own, case when page_id % 7 = 1 then 'side' || (page_id % 3) end side from pages) select page_id, coalesce(case when page_id % 4 <> 0 then side end, nullif(regexp_extract(path, '(?:^|/)contributor[_-]([^/]+)/', 1), ''), nullif(own, '')) contributor, case when page_id % 4 <> 0 and side is not null then 'sidecar' when page_id % 4 = 0 then 'directory' when own <> '' then 'format' else 'none' end tier from s")
def contributors(spark, sf_dir):
    i = F.col("page_id")
    s = table(spark, sf_dir, "pages").select("page_id", F.when(i % 4 == 0, F.concat(F.lit("contributor_"), (i % 3).cast("string"), F.lit("/x.jpg"))).otherwise(F.concat(F.lit("x"), i.cast("string"), F.lit(".jpg"))).alias("path"), F.when(i % 5 == 0, F.concat(F.lit("own"), (i % 2).cast("string"))).otherwise("").alias("contributor"))
    side = s.where((i % 7 == 1) & (i % 4 != 0)).select(F.col("path").alias("name"), F.concat(F.lit("side"), (i % 3).cast("string")).alias("contributor"))
    return datasets.resolve_contributor(s, side).select("page_id", "contributor", "tier")


@query("P06_batches", "select doc_id, left(trim(coalesce(nullif(case when doc_id % 5 = 0 then 'b ' || lang else '' end, ''), case when doc_id % 2 = 0 then 'batch_' || source when doc_id % 3 = 0 then 'source_' || source end)), 128) batch from documents")
def batches(spark, sf_dir):
    i = F.col("doc_id")
    path = F.concat(F.lit("root/"), F.when(i % 2 == 0, F.concat(F.lit("source_z/batch_"), "source", F.lit("/"))).when(i % 3 == 0, F.concat(F.lit("source_"), "source", F.lit("/"))).otherwise(""), F.lit("f.jpg"))
    return table(spark, sf_dir, "documents").select("doc_id", datasets.resolve_batch(path, F.when(i % 5 == 0, F.concat(F.lit("b "), "lang")).otherwise("")).alias("batch"))


@query("P25_request_errors", "with r as (select event_id, ['assign', 'override', 'release', 'dance', 'approve'][(event_id % 5 + 1)::int] as action, event_id % 8 < 2 prov, case when event_id % 11 = 0 then 'XYZ' else substr(sha256(props), 1, 16) end request_id, case when event_id % 3 = 0 then 'too short' else 'long enough text' end justification, case event_id % 4 when 0 then 'known_benign' when 1 then 'test_data' else 'nothing' end reason_code, case when event_id % 2 = 0 then 'u' end assignee from events) select event_id, case when action = 'dance' then 'unknown_action' when not regexp_matches(request_id, '^[0-9a-f]{8,64}$') then 'bad_request_id' when action in ('override', 'release') and length(trim(justification)) < 10 then 'justification_too_short' when action = 'override' and reason_code <> case when prov then 'test_data' else 'known_benign' end then 'unknown_reason_code' when action = 'assign' and assignee is null then 'no_assignee' end error from r")
def request_errors(spark, sf_dir):
    i = F.col("event_id")
    r = table(spark, sf_dir, "events").select(
        "event_id", F.element_at(F.array(*(F.lit(a) for a in ("assign", "override", "release", "dance", "approve"))), (i % 5 + 1).cast("int")).alias("action"),
        F.when(i % 11 == 0, "XYZ").otherwise(F.left(F.sha2(F.col("props").cast("binary"), 256), F.lit(16))).alias("request_id"), F.when(i % 3 == 0, "too short").otherwise("long enough text").alias("justification"),
        F.when(i % 4 == 0, "known_benign").when(i % 4 == 1, "test_data").otherwise("nothing").alias("reason_code"), F.when(i % 8 < 2, "prov.chain").otherwise("copies.text").alias("detector_id"), F.when(i % 2 == 0, "u").alias("assignee"),
    )
    return r.select("event_id", governance.error_code().alias("error"))


@query("A26_heavy_contributors", "select source contributor, count(*) n, count(*) filter (n_chars > 3000) k, count(*) filter (n_chars > 3000) / count(*) as share, count(*) filter (n_chars > 3000) >= 10 and count(*) filter (n_chars > 3000) / count(*) >= 0.2 heavy from documents group by source")
def heavy_contributors(spark, sf_dir):
    return labels.heavy_contributors(table(spark, sf_dir, "documents").select(F.col("source").alias("contributor"), (F.col("n_chars") > 3000).alias("flagged")))


@query("A29_class_thresholds", "select label, round(avg(1 / (1 + abs(embedding[1]))), 6) threshold from embeddings group by label")
def class_thresholds(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    probs = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.lit(1.0) / (F.lit(1.0) + F.abs(F.col("vector")[0].cast("double"))))
    return labels.class_thresholds(v.select("id", "label", probs.alias("probs"))).withColumn("threshold", F.round("threshold", 6))


@query("A30_confident_errors")
def confident_errors(spark, sf_dir):
    return labels.confident_errors(labels.out_of_fold(_vectors(spark, sf_dir), folds=3))


@query("A62_spectral_scores")
def spectral_scores(spark, sf_dir):
    return labels.spectral_scores(_vectors(spark, sf_dir))


@query("A34_activation_stats", "with t as (select l_returnflag layer, quantile_cont(l_quantity - 10, 0.999) p from lineitem group by all), u as (select l_returnflag layer, l_linenumber unit, max(l_quantity - 10) m, avg(case when l_quantity - 10 >= p then 1.0e0 else 0.0e0 end) sat from lineitem join t on l_returnflag = layer group by all) select layer, avg(case when m <= 0 then 1.0e0 else 0.0e0 end) dead_share, round(max(sat), 9) saturation, max(m) top from u group by layer")
def activation_stats(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("layer"), F.col("l_linenumber").alias("unit"), (F.col("l_quantity") - 10).alias("value"))
    return models.activation_stats(a).withColumn("saturation", F.round("saturation", 9))


@query("A67_weakest_tier", "with t as (select source contributor, case when doc_id % 7 = 0 then 'none' when doc_id % 3 = 0 then 'format' else 'directory' end tier from documents) select contributor, arg_max(tier, case tier when 'none' then 3 when 'format' then 2 when 'directory' then 1 else 0 end) weakest from t group by contributor")
def weakest_tier(spark, sf_dir):
    i = F.col("doc_id")
    t = table(spark, sf_dir, "documents").select(F.col("source").alias("contributor"), F.when(i % 7 == 0, "none").when(i % 3 == 0, "format").otherwise("directory").alias("tier"))
    return t.groupBy("contributor").agg(F.max_by("tier", risk.rank_of(F.col("tier"), ("sidecar", "directory", "format", "none"))).alias("weakest"))


@query("A69_qualified_verdict", f"with {ROUTED_SQL}, v as (select scan_id, case when bool_or(availability = 'ran' and disposition = 'quarantine') then 'QUARANTINE' when bool_or(availability = 'error') then 'REVIEW' when bool_or(availability = 'ran' and disposition = 'review' and {_RANK} >= 2) then 'REVIEW' else 'ACCEPT' end verdict, count(*) n, count(*) filter (availability = 'ran') ran, count(*) filter (availability = 'error') crashed, count(*) filter (availability = 'unavailable') not_assessed from routed group by scan_id) select scan_id, ran, crashed, not_assessed, case when ran = n then verdict || ' (all assessed)' else printf('%s (%d of %d assessed; %d crashed; %d not assessed)', verdict, ran, n, crashed, not_assessed) end line from v")
def qualified_verdict(spark, sf_dir):
    return governance.qualified_verdict(_routed(spark, sf_dir))


@query("J21_orphan_events", f"with f as (select target_ref from ({inputs.FINDINGS_SQL}) where detector_id = 'copies.text') select event_id from events where cast(event_id % 700 as varchar) not in (select target_ref from f)")
def orphan_events(spark, sf_dir):
    f = inputs.findings(spark, sf_dir).where("detector_id = 'copies.text'").select(F.col("target_ref").alias("finding_id"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 700).cast("string").alias("finding_id"))
    return governance.orphans(f, e).select("event_id")


_UP = "select lang, k >> 12 k, sha256(string_agg(t, '|' order by k, t)) t from {0} group by all"


@query("A43_dataset_id", f"with d as (select lang, doc_id k, doc_id || ':' || sha256(text) t from documents where text is not null), a as ({_UP.format('d')}), b as ({_UP.format('a')}), c as ({_UP.format('b')}), e as ({_UP.format('c')}) select lang, sha256(string_agg(t, '|' order by k, t)) dataset_id from e group by lang")
def dataset_id(spark, sf_dir):
    text = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2(F.col("text").cast("binary"), 256))
    return reading.ordered_digest(table(spark, sf_dir, "documents").where("text is not null"), "lang", "doc_id", text, "dataset_id")


@query("P15_digest_defers", f"with f as ({inputs.FINDINGS_SQL}), r as (select scan_id, bool_or(detector_id = 'drift.length' and availability = 'ran') ran from f group by scan_id) select finding_id, case when detector_id = 'copies.text' and ran then 'info' else severity end severity from f join r using (scan_id)")
def digest_defers(spark, sf_dir):
    f = inputs.findings(spark, sf_dir).withColumn("detector_id", F.when(F.col("detector_id") == "copies.text", "model.digest").when(F.col("detector_id") == "drift.length", "model.fingerprint").otherwise(F.col("detector_id")))
    return risk.defer_digest(f).select("finding_id", "severity")


@query("O03_severity_order", f"with {ROUTED_SQL} select finding_id, row_number() over (order by {_RANK} desc, confidence desc, finding_id) as place from routed")
def severity_order(spark, sf_dir):
    return governance.findings_by_severity(_routed(spark, sf_dir)).select("finding_id", "place")


@query("J12_link_to_previous", f"with {_LEDGER} select seq, lag(sha256(unhex('02') || rec::blob)) over (order by seq) prev from l")
def link_to_previous(spark, sf_dir):
    l = inputs.ledger(spark, sf_dir).select("seq", ledger.link_hash(F.col("rec")).alias("h"))
    return ledger.in_order(l, {"prev": "h"}).select("seq", "prev")


@query("J25_layer_z", "with m as (select l_returnflag layer, l_linestatus model, kurtosis_pop(l_extendedprice) k from lineitem group by all), b as (select layer, avg(k) m, stddev_pop(k) s from m where model = 'O' or layer <> 'N' group by layer) select m.layer, m.model, round((k - b.m) / nullif(b.s, 0), 4) z from m join b using (layer)")
def layer_z(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("layer"), F.col("l_linestatus").alias("model")).agg(F.kurtosis("l_extendedprice").alias("kurtosis"))
    return models.against_battery(w, w.where("model = 'O' or layer <> 'N'")).select("layer", "model", F.round("z", 4).alias("z"))
