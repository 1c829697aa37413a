"""Registered queries over the driver's tables, each with its SQL statement where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import scalars
from veristrata.operators import cohorts, drift, evaluation, governance, labels, ledger, models, risk, similarity
from veristrata.plans import capability, inputs
from veristrata.sources import datasets
from veristrata.sources.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# ---- similarity ----

_LOW = "lower(coalesce(text, ''))"


def _count(part: str, text: str = _LOW) -> str:
    return f"((length({text}) - length(replace({text}, '{part}', ''))) // {len(part)})"


_TOTAL = "(" + " + ".join(_count(c) for c in similarity.LETTERS) + ")"
_HALF = f"substr({_LOW}, 1, length({_LOW}) // 2)"
_BITS = [f"{_count(c)} * 26 > {_TOTAL}" for c in similarity.LETTERS] + [f"{_count(c, _HALF)} * 2 > {_count(c)}" for c in similarity.LETTERS] + [f"{_count(p)} * 60 > {_TOTAL}" for p in similarity.PAIRS]
HASH_SQL = "select doc_id as id, " + " + ".join(f"case when {b} then {1 << i} else 0 end::bigint" for i, b in enumerate(_BITS)) + " as hash from documents"
CUT = 2
PAIRS_SQL = f"h as materialized ({HASH_SQL}), r as materialized (select hash, min(id) id from h group by hash), pairs as materialized (select a.id id_a, b.id id_b, bit_count(xor(a.hash, b.hash))::int distance from r a join r b on a.id < b.id where bit_count(xor(a.hash, b.hash)) <= {CUT})"
CLUSTERS_SQL = f"{PAIRS_SQL}, e as (select id_a a, id_b b from pairs union select id_b, id_a from pairs), reach as (select a id, a c from e union select e.b, reach.c from reach join e on e.a = reach.id), near as (select id, min(c) cluster_id from reach group by id), whole as (select h.id, h.hash, coalesce(near.cluster_id, r.id) cluster_id from h join r on h.hash = r.hash left join near on near.id = r.id), clusters as materialized (select id, hash, cluster_id from whole qualify count(*) over (partition by cluster_id) >= 2)"


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), similarity.profile_hash(F.col("text")).alias("hash"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_pairs(_hashes(spark, sf_dir).groupBy("hash").agg(F.min("id").alias("id")))


def _rows_and_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hashes of all documents, and links that connect hash classes; each is read more than once."""
    rows = cut(_hashes(spark, sf_dir))
    return rows, cut(similarity.near_links(rows.groupBy("hash").agg(F.min("id").alias("id"))))


@query("F06_profile_hash", HASH_SQL)
def profile_hash(spark, sf_dir):
    return _hashes(spark, sf_dir)


@query("J01_hamming_pairs", f"with {PAIRS_SQL} select * from pairs")
def hamming_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("A63_clusters", f"with recursive {CLUSTERS_SQL} select id, cluster_id from clusters")
def clusters(spark, sf_dir):
    return similarity.document_clusters(*_rows_and_links(spark, sf_dir)).select("id", "cluster_id")


@query("A31_cluster_stats", f"with recursive {CLUSTERS_SQL}, d as (select cluster_id, min(distance) d from clusters join pairs on id in (id_a, id_b) group by cluster_id) select cluster_id, count(*) n, case when count(distinct hash) < count(*) then 0 else any_value(d) end min_distance, case when count(*) >= 10 then 'high' when count(*) >= 3 then 'medium' else 'low' end severity from clusters left join d using (cluster_id) group by cluster_id")
def cluster_stats(spark, sf_dir):
    rows, links = _rows_and_links(spark, sf_dir)
    return similarity.cluster_stats(links, similarity.document_clusters(rows, links))


@query("A32_label_conflicts", f"with recursive {CLUSTERS_SQL}, sets as (select cluster_id, id, array_to_string(list_sort(list_distinct(list_filter([source, lang], lambda x: x is not null))), ',') label_set from clusters join documents on doc_id = id), n as (select cluster_id, label_set, count(*) n from sets where label_set <> '' group by all), ranked as (select *, row_number() over (partition by cluster_id order by n desc, label_set) k, count(*) over (partition by cluster_id) n_sets from n) select a.cluster_id, a.n_sets, a.label_set majority_set, a.n > b.n strict_majority from ranked a join ranked b on a.cluster_id = b.cluster_id and a.k = 1 and b.k = 2")
def label_conflicts(spark, sf_dir):
    labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array("source", "lang")).alias("label")).where("label is not null")
    return similarity.label_conflicts(similarity.document_clusters(*_rows_and_links(spark, sf_dir)).select("id", "cluster_id"), labels)


_COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"
KNN_SQL = f"knn as materialized (select * from (select a.vec_id query_id, (row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id))::int as rank, b.vec_id id, round({_COS}, 6) cosine from embeddings a join embeddings b on a.vec_id <> b.vec_id) where rank <= 10)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query("J03_knn", f"with {KNN_SQL} select * from knn")
def knn(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "vector")
    return similarity.nearest(v, v, 10).withColumn("cosine", F.round("cosine", 6))


@query("A28_label_agreement", f"with {KNN_SQL}, j as (select query_id, avg(case when b.label = a.label then 1.0 else 0.0 end) agreement, count(*) n from knn join embeddings a on a.vec_id = query_id join embeddings b on b.vec_id = id group by query_id) select query_id, n, agreement, agreement <= 0.2 flagged from j where n >= 5")
def label_agreement(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    rows = v.select("id", "vector")
    return similarity.label_agreement(similarity.nearest(rows, rows, 10), v.select("id", "label"))


@query("J02_confirmed_pairs", f"with {KNN_SQL}, p as (select distinct least(query_id, id) id_a, greatest(query_id, id) id_b from knn), c as (select id_a, id_b, {_COS} c from p join embeddings a on a.vec_id = id_a join embeddings b on b.vec_id = id_b) select id_a, id_b, round(c, 6) as cosine from c where c >= 0.1")
def confirmed_pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "vector")
    pairs = similarity.nearest(v, v, 10).select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b")).distinct()
    return similarity.confirm_pairs(pairs, v, 0.1).select("id_a", "id_b", F.round("cosine", 6).alias("cosine"))


@query("J04_reference_distance", f"with k as (select a.vec_id query_id, {_COS} c, row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) r from embeddings a join embeddings b on a.label = 0 and b.label = 1) select query_id, round(1 - avg(c), 6) distance from k where r <= 5 group by query_id")
def reference_distance(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return similarity.reference_distance(v.where("label = 0").select("id", "vector"), v.where("label = 1").select("id", "vector")).select("query_id", F.round("distance", 6).alias("distance"))


@query("A27_ood_threshold", f"with k as (select a.vec_id q, {_COS} c, row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id and a.label = 1 and b.label = 1), d as (select q, 1 - avg(c) d from k where r <= 5 group by q) select round(quantile_cont(d, 0.99) * 1.15, 6) threshold from d")
def ood_threshold(spark, sf_dir):
    t = similarity.leave_one_out_threshold(_vectors(spark, sf_dir).where("label = 1").select("id", "vector"))
    return spark.createDataFrame([(round(t, 6),)], "threshold double")


# ---- drift ----

_EDGES = "v as materialized (" + inputs.AXES_SQL + "), edges as materialized (select axis, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) edges from v group by axis), cells as materialized (select axis, len(list_filter(edges, lambda e: e <= value)) bin, count(*) filter (batch = 0) n_ref, count(*) filter (batch = 1) n_inc from v join edges using (axis) group by all)"


@query("A09_psi", f"with {_EDGES}, t as (select axis, sum(n_ref) n, sum(n_inc) m, count(*) bins from cells group by axis), p as (select axis, bins, n, m, (n_ref + 0.5e0) / (n + 0.5e0 * bins) p, (n_inc + 0.5e0) / (m + 0.5e0 * bins) q from cells join t using (axis)) select axis, round(sum((p - q) * ln(p / q)), 6) psi, bins, n::bigint n_ref, m::bigint n_inc from p group by axis, bins, n, m")
def psi(spark, sf_dir):
    return drift.stability_index(inputs.axes(spark, sf_dir)).withColumn("psi", F.round("psi", 6))


KS_SQL = "ks as (with v as (" + inputs.AXES_SQL + "), g as (select axis, value, count(*) filter (batch = 0) r, count(*) filter (batch = 1) i from v group by all), c as (select axis, sum(r) over w cr, sum(i) over w ci, sum(r) over (partition by axis) n, sum(i) over (partition by axis) m from g window w as (partition by axis order by value)) select axis, max(abs(cr / n - ci / m)) ks, any_value(n)::bigint n_ref, any_value(m)::bigint n_inc from c group by axis)"


@query("A11_ks", f"with {KS_SQL} select axis, round(ks, 6) ks, n_ref, n_inc from ks")
def ks(spark, sf_dir):
    return drift.ks_statistic(inputs.axes(spark, sf_dir)).withColumn("ks", F.round("ks", 6))


@query("A13_bh_adjust", "with p as (select doc_id as name, lang as family, (((doc_id * 7919) % 1000) + 1) / 1000.0e0 p from documents), r as (select *, row_number() over (partition by family order by p, name) k, count(*) over (partition by family) n from p) select name, family, p, k::int as rank, round(least(1, min(p * n / k) over (partition by family order by k desc)), 9) q from r")
def bh_adjust(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("lang").alias("family"), (((F.col("doc_id") * 7919) % 1000 + 1) / 1000.0).alias("p"))
    return drift.adjust_bh(p, "family").withColumn("q", F.round("q", 9))


@query("A14_material_shift")
def material_shift(spark, sf_dir):
    return drift.assess(inputs.axes(spark, sf_dir))


@query("A15_centroid_distance", "with u as (select label % 2 b, unnest(embedding)::double x, generate_subscripts(embedding, 1) d from embeddings), s as (select b, d, avg(x) m, var_samp(x) v from u group by all), p as (select r.m - i.m dm, greatest(r.v, 1e-6) v from s r join s i on r.d = i.d and r.b = 0 and i.b = 1) select round(sqrt(sum(dm * dm)), 6) euclid, round(sqrt(sum(dm * dm / v)), 6) mahalanobis from p")
def centroid_distance(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    cast = v.withColumn("vector", F.col("vector").cast("array<double>"))
    return drift.centroid_distance(cast.where("label % 2 = 0"), cast.where("label % 2 = 1")).select(F.round("euclid", 6).alias("euclid"), F.round("mahalanobis", 6).alias("mahalanobis"))


@query("A16_axis_summary", f"with v as ({inputs.AXES_SQL}) select axis, batch, count(*) n, round(avg(value), 4) mean, min(value) low, max(value) high from v group by all")
def axis_summary(spark, sf_dir):
    return drift.axis_summary(inputs.axes(spark, sf_dir)).withColumn("mean", F.round("mean", 4))


@query("J11_unmatched_axes", "with r as (select distinct event_type axis from events where user_id % 2 = 0 and event_type <> 'click'), i as (select distinct event_type axis from events where user_id % 2 = 1 and event_type <> 'view') select axis, 'reference' only_in from r where axis not in (select axis from i) union all select axis, 'incoming' from i where axis not in (select axis from r)")
def unmatched_axes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("axis"))
    return drift.unmatched_axes(e.where("user_id % 2 = 0 and axis <> 'click'"), e.where("user_id % 2 = 1 and axis <> 'view'"))


@query("J10_content_overlap", "select count(distinct sha256(text)) shared from documents where lang = 'en' and sha256(text) in (select sha256(text) from documents where lang <> 'en') ")
def content_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("lang", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    both = d.where("lang = 'en'").join(d.where("lang <> 'en'").select("content"), "content", "left_semi")
    return both.agg(F.count_distinct("content").alias("shared"))


# ---- groups against peers ----


@query("A17_robust_z", "with m as (select source, median(n_chars) m from documents group by source), s as (select source, median(abs(n_chars - m)) * 1.4826e0 s from documents join m using (source) group by source) select doc_id, round((n_chars - m) / greatest(s, 0.1e0), 6) z from documents join m using (source) join s using (source)")
def robust_z(spark, sf_dir):
    return cohorts.robust_z(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], "n_chars").select("doc_id", F.round("z", 6).alias("z"))


@query("A19_top_share", "with c as (select source, lang, count(*) n from documents where lang is not null group by all), r as (select *, row_number() over (partition by source order by n desc, lang) k, sum(n) over (partition by source) t from c) select source, lang top_value, (n / t)::double as share from r where k = 1")
def top_share(spark, sf_dir):
    return cohorts.top_share(table(spark, sf_dir, "documents"), "source", "lang")


@query("A20_burst_share", "with g as (select user_id, epoch_us(ts) / 1000000.0e0 - lag(epoch_us(ts) / 1000000.0e0) over (partition by user_id order by ts) gap from events) select user_id, case when count(*) < 3 then 0.0e0 else avg(case when gap is null then null when gap < 600 then 1.0e0 else 0.0e0 end) end burst_share, count(*) n from g group by user_id")
def burst_share(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))
    return cohorts.burst_share(e, "user_id", "t", 600.0)


@query("A37_mad_index", "with v as (select l_suppkey k, avg(l_quantity) x from lineitem group by all), m as (select median(x) m from v), s as (select median(abs(x - m)) * 1.4826e0 s from v, m) select k, round((m - x) / greatest(s, m * 0.05e0, 1e-9), 6) anomaly_index from v, m, s")
def mad_index(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("x"))
    return cohorts.mad_index(v, "x").select("k", F.round("anomaly_index", 6).alias("anomaly_index"))


@query("A23_confusion_cells", f"with p as ({inputs.PREDICTIONS_SQL}), n as (select contributor, label, count(*) n from p group by all) select contributor, label, predicted, count(*) hits, any_value(n) n, count(*) / any_value(n) as rate from p join n using (contributor, label) where label <> predicted group by contributor, label, predicted")
def confusion_cells(spark, sf_dir):
    return cohorts.confusion_cells(inputs.predictions(spark, sf_dir))


@query("A24_mislabel_tests")
def mislabel_tests(spark, sf_dir):
    return cohorts.mislabel_tests(inputs.predictions(spark, sf_dir))


@query("J08_share_against_rest", "with g as (select source, count(*) n, count(*) filter (n_chars > 2000) k from documents group by source) select source, n, k, k / n as share, (sum(k) over () - k) / nullif(sum(n) over () - n, 0) rest_share from g")
def share_against_rest(spark, sf_dir):
    return cohorts.share_against_rest(table(spark, sf_dir, "documents"), "source", F.col("n_chars") > 2000)


@query("J09_others_max", "with g as (select source, max(n_chars) longest from documents group by source) select a.source, a.longest, (select max(b.longest) from g b where b.source <> a.source) others_max from g a")
def others_max(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("n_chars").alias("longest"))
    return cohorts.others_max(g, "source", "longest")


@query("A66_group_key", "with k as (select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then source else '' end, ''), nullif(case when doc_id % 2 = 0 then lang else '' end, ''), 'all') group_key, case when doc_id % 3 = 0 then 'contributor' when doc_id % 2 = 0 then 'batch' else 'dataset' end group_type from documents) select group_type, group_key, count(*) n from k group by all having count(*) >= 20")
def group_key(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 3 == 0, F.col("source")).otherwise("").alias("contributor"), F.when(i % 2 == 0, F.col("lang")).otherwise("").alias("batch"))
    return cohorts.group_key(d).groupBy("group_type", "group_key").agg(F.count("*").alias("n"))


@query("A21_box_features", f"with b as ({inputs.BOXES_SQL}) select contributor, category, count(*) n, round(avg(ln(w * h)), 6) log_area, round(avg(ln(w / h)), 6) log_aspect, round(avg(x + w / 2), 6) cx, round(avg(y + h / 2), 6) cy from b where w > 0 and h > 0 group by all")
def box_features(spark, sf_dir):
    long = cohorts.box_features(inputs.boxes(spark, sf_dir))
    wide = long.groupBy("contributor", "category").pivot("feature", ["log_area", "log_aspect", "cx", "cy"]).agg(F.round(F.avg("value"), 6))
    n = long.where("feature = 'cx'").groupBy("contributor", "category").agg(F.count("*").alias("n"))
    return wide.join(n, ["contributor", "category"])


_MOVED = f"mv as (select sample_id, contributor, category, x + case when contributor = 'c3' then 40 else 0 end x, y, w, h from ({inputs.BOXES_SQL}) where w > 0 and h > 0), f as (select contributor, category, unnest(['log_area', 'log_aspect', 'cx', 'cy']) feature, unnest([ln(w * h), ln(w / h), x + w / 2, y + h / 2]) as value from mv)"


def _moved(spark, sf_dir):
    """Box features by sample; the boxes of contributor c3 are moved to the right."""
    boxes = inputs.boxes(spark, sf_dir).withColumn("x", F.col("x") + F.when(F.col("contributor") == "c3", 40).otherwise(0))
    return cohorts.box_features(boxes, ["sample_id"])


@query(
    "A22_geometry_shift",
    f"with {_MOVED}, m as (select category, feature, contributor, median(value) as mid, count(*) n from f group by all having count(*) >= 15), "
    "g as (select category, feature, contributor, any_value(n) n, any_value(mid) mid, greatest(median(abs(value - mid)) * 1.4826e0, any_value(case feature when 'log_area' then 0.05e0 when 'log_aspect' then 0.03e0 else 0.02e0 end)) spread from f join m using (category, feature, contributor) group by all) "
    "select a.category, a.feature, a.contributor, a.n, round(a.mid, 6) as median, round(a.spread, 6) spread, (select count(*) from g b where b.category = a.category and b.feature = a.feature and b.contributor <> a.contributor) peers, "
    "(select case when count(*) = 0 then null when bool_and(a.mid >= b.mid + b.spread) then 1 when bool_and(a.mid <= b.mid - b.spread) then -1 else 0 end from g b where b.category = a.category and b.feature = a.feature and b.contributor <> a.contributor)::int side from g a",
)
def geometry_shift(spark, sf_dir):
    return cohorts.geometry_shift(_moved(spark, sf_dir)).withColumn("median", F.round("median", 6)).withColumn("spread", F.round("spread", 6))


@query("J07_geometry_tests")
def geometry_tests(spark, sf_dir):
    """KS tests of the contributors to one side of every peer; tests hold them against brute force."""
    return cohorts.geometry_tests(_moved(spark, sf_dir))


@query("A22_geometry_hits")
def geometry_hits(spark, sf_dir):
    moved = _moved(spark, sf_dir)
    return cohorts.geometry_hits(moved, cohorts.geometry_tests(moved))


_IOU = "greatest(0, least(d.x + d.w, b.x + b.w) - greatest(d.x, b.x)) * greatest(0, least(d.y + d.h, b.y + b.h) - greatest(d.y, b.y))"


@query("J06_unmatched_detections", f"with a as ({inputs.BOXES_SQL}), d as (select * from a where det_id % 2 = 1), b as (select * from a where det_id % 2 = 0) select sample_id, det_id from d where not exists (select 1 from b where b.sample_id = d.sample_id and coalesce({_IOU} / nullif(d.w * d.h + b.w * b.h - {_IOU}, 0), 0) >= 0.3)")
def unmatched_detections(spark, sf_dir):
    a = inputs.boxes(spark, sf_dir).select("sample_id", "det_id", "x", "y", "w", "h")
    return cohorts.unmatched_detections(a.where("det_id % 2 = 1"), a.where("det_id % 2 = 0").drop("det_id")).select("sample_id", "det_id")


@query("A65_best_missed", f"with a as ({inputs.BOXES_SQL}), d as (select * from a where det_id % 2 = 1), b as (select * from a where det_id % 2 = 0) select sample_id, det_id, d.x as score from d where not exists (select 1 from b where b.sample_id = d.sample_id and coalesce({_IOU} / nullif(d.w * d.h + b.w * b.h - {_IOU}, 0), 0) >= 0.3) qualify row_number() over (partition by sample_id order by d.x desc, det_id) = 1")
def best_missed(spark, sf_dir):
    a = inputs.boxes(spark, sf_dir).select("sample_id", "det_id", "x", "y", "w", "h")
    return labels.best_missed(a.where("det_id % 2 = 1").withColumn("score", F.col("x")), a.where("det_id % 2 = 0").drop("det_id"))


_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"


@query(
    "A25_negative_space",
    "with r as (select 'c' || (l_suppkey % 10) contributor, l_partkey % case l_suppkey % 10 when 4 then 3 when 5 then 9 else 40 end = 0 missed from lineitem), "
    "g as (select contributor, count(*) n, count(*) filter (missed) k from r group by 1), "
    "o as (select a.contributor, a.n, a.k, coalesce(max(b.k / b.n), 0.0e0) worst_peer, coalesce(sum(b.n), 0)::double rest_n, coalesce(sum(b.k), 0)::double rest_k, (select count(*) from g) family from g a left join g b on b.contributor <> a.contributor and b.n >= 10 group by all), "
    f"p as (select *, least(1.0e0, family * (select sum(exp({_CHOOSE.format('o.n', 'i')} + {_CHOOSE.format('o.rest_n', '(o.k + o.rest_k - i)')} - ({_CHOOSE.format('(o.n + o.rest_n)', '(o.k + o.rest_k)')}))) from (select unnest(generate_series(o.k, least(o.n, o.k + o.rest_k)::bigint)) i) s)) p from o) "
    "select contributor, n, k, k / n as rate, worst_peer, round(p, 6) p, rest_n > 0 and k >= 5 and k / n >= 0.15e0 and k / n >= 3.0e0 * greatest(worst_peer, 0.02e0) and p < 1e-3 flagged from p",
)
def negative_space(spark, sf_dir):
    """Contributor c4 leaves out a third of its rows, c5 a ninth."""
    who = F.col("l_suppkey") % 10
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), who.cast("string")).alias("contributor"), (F.col("l_partkey") % F.when(who == 4, 3).when(who == 5, 9).otherwise(40) == 0).alias("missed"))
    return labels.negative_space(rows.where("missed"), rows).withColumn("p", F.round("p", 6))


# ---- findings, rules, risk ----

_RANK = "case severity when 'info' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 end"
ROUTED_SQL = f"""f as ({inputs.FINDINGS_SQL}), routed as (select *,
  case when attack_class like 'copies%' and (not calibrated or confidence >= 0.9) and {_RANK} >= 3 then case when calibrated then 'quarantine' else 'review' end
       when attack_class like 'copies%' and {_RANK} >= 2 then 'review' when attack_class like 'drift%' then 'review'
       when detector_id like 'label.%' and (not calibrated or confidence >= 0.5) then 'review' else 'accept' end disposition,
  case when attack_class like 'copies%' and (not calibrated or confidence >= 0.9) and {_RANK} >= 3 then 'R1'
       when attack_class like 'copies%' and {_RANK} >= 2 then 'R2' when attack_class like 'drift%' then 'R3'
       when detector_id like 'label.%' and (not calibrated or confidence >= 0.5) then 'R4' else 'R5' end as rule from f)"""


def _routed(spark, sf_dir):
    return risk.route(inputs.findings(spark, sf_dir))


@query("F02_finding_id", f"select finding_id, target_ref from ({inputs.FINDINGS_SQL})")
def finding_ids(spark, sf_dir):
    return inputs.findings(spark, sf_dir).select("finding_id", "target_ref")


@query("P13_rule_table", f"with {ROUTED_SQL} select finding_id, disposition, rule from routed")
def rule_table(spark, sf_dir):
    return _routed(spark, sf_dir).select("finding_id", "disposition", "rule")


@query("P11_flagged_samples", f"with {ROUTED_SQL} select distinct target_ref sample_id from routed where availability = 'ran' and disposition <> 'accept'")
def flagged_samples(spark, sf_dir):
    return risk.flagged_samples(_routed(spark, sf_dir))


@query("P12_fired", f"with {ROUTED_SQL} select finding_id from routed where availability = 'ran' and disposition in ('review', 'quarantine') and {_RANK} >= 2")
def fired(spark, sf_dir):
    return risk.fired(_routed(spark, sf_dir)).select("finding_id")


@query("P17_verdict", f"with {ROUTED_SQL} select scan_id, case when bool_or(availability = 'ran' and disposition = 'quarantine') then 'QUARANTINE' when bool_or(availability = 'error') then 'REVIEW' when bool_or(availability = 'ran' and disposition = 'review' and {_RANK} >= 2) then 'REVIEW' else 'ACCEPT' end verdict from routed group by scan_id")
def verdict(spark, sf_dir):
    return risk.verdict(_routed(spark, sf_dir))


@query("A41_finding_counts", f"with {ROUTED_SQL} select severity, disposition, count(*) n from routed group by all")
def finding_counts(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("severity", "disposition").agg(F.count("*").alias("n"))


@query("A61_combined_confidence", "select lang target_ref, round(least(0.95e0, 1 - product(1 - c)), 9) confidence, count(*) methods from (select lang, (doc_id % 5) / 100.0e0 c from documents) group by lang")
def combined_confidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("target_ref"), ((F.col("doc_id") % 5) / 100.0).alias("confidence"))
    return risk.combine_methods(d).withColumn("confidence", F.round("confidence", 9))


@query("O01_findings_page", f"with {ROUTED_SQL} select finding_id, severity, confidence from (select *, {_RANK} r from routed where availability = 'ran' and detector_id like 'copies.%') order by r desc, confidence desc, finding_id limit 50 offset 20")
def findings_page(spark, sf_dir):
    return governance.page_of_findings(_routed(spark, sf_dir), 50, 20, availability="ran", module="copies").select("finding_id", "severity", "confidence")


@query("A01_group_counts", f"with {ROUTED_SQL}, hit as (select distinct target_ref from routed where availability = 'ran' and disposition <> 'accept'), s as (select cast(doc_id as varchar) id, source contributor, lang batch, null::varchar source from documents), g as (select id, unnest(['contributor', 'batch', 'source']) kind, unnest([contributor, batch, source]) \"group\" from s) select kind, \"group\", count(*) n, count(target_ref) k from g left join hit on target_ref = id where \"group\" is not null and \"group\" <> '' group by all")
def group_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("contributor"), F.col("lang").alias("batch"), F.lit(None).cast("string").alias("source"))
    return risk.group_counts(d, risk.flagged_samples(_routed(spark, sf_dir)))


@query("contributor_ranking")
def contributor_ranking(spark, sf_dir):
    """Which sources have an abnormal flagged rate? Copies found by hash, clustered, routed, counted, and ranked by posterior interval."""
    docs = table(spark, sf_dir, "documents")
    hashes, links = _rows_and_links(spark, sf_dir)
    found = hashes.join(similarity.sized_classes(hashes, similarity.clusters(links)), "hash").select(
        F.col("id").cast("string").alias("target_ref"), F.lit("sample").alias("target_type"), F.lit("scan-0").alias("scan_id"), F.lit("copies.text").alias("detector_id"), F.lit("copies_near").alias("attack_class"),
        "severity", F.least(F.lit(0.95), F.lit(0.5) + F.col("cluster_n") / 20.0).alias("confidence"), F.lit(False).alias("calibrated"), F.lit("ran").alias("availability"),
    )
    samples = docs.select(F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("contributor"), F.col("lang").alias("batch"))
    counts = risk.group_counts(samples, risk.flagged_samples(risk.route(found)), ("contributor",))
    return risk.rank_groups(counts)


@query("F31_calibrated", "with e as (select [0.0e0, 1.0, 2.0, 4.0] e, [0.05e0, 0.2, 0.6, 0.9] l) select doc_id, l[least(4, 1 + len(list_filter(e, lambda x: x <= n_chars / 1000.0e0 - 1e-12)))] confidence from documents, e")
def calibrated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("score"), F.lit("d").alias("detector_id"), F.lit(0.0).alias("confidence"))
    steps = spark.createDataFrame([("d", [0.0, 1.0, 2.0, 4.0], [0.05, 0.2, 0.6, 0.9])], "detector_id string, edges array<double>, levels array<double>")
    return risk.calibrate(d, steps).select("doc_id", "confidence")


@query("A55_isotonic_steps")
def isotonic_steps(spark, sf_dir):
    return risk.fit_calibration(inputs.subjects(spark, sf_dir).select("detector_id", "score", "attacked"))


@query("A56_reliability", "select detector_id, bin, count(*) n, round(avg(p), 9) mean_predicted, avg(y) observed, round(avg((p - y) * (p - y)), 9) brier from (select 'd' || (o_custkey % 4) detector_id, p, y, least(floor(p * 10), 9)::int as bin from (select o_custkey, (o_orderkey % 100) / 100.0e0 p, case when o_orderstatus = 'F' then 1.0e0 else 0.0e0 end y from orders)) group by all")
def reliability(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), (F.col("o_custkey") % 4).cast("string")).alias("detector_id"), ((F.col("o_orderkey") % 100) / 100.0).alias("predicted"), (F.col("o_orderstatus") == "F").alias("attacked"))
    return risk.reliability(o).withColumn("mean_predicted", F.round("mean_predicted", 9)).withColumn("brier", F.round("brier", 9))


# ---- evaluation ----

_SUBJECTS = f"s as ({inputs.SUBJECTS_SQL})"


@query("A44_wilson", f"with {_SUBJECTS}, g as (select family, count(*)::double n, (count(*) filter (attacked))::double k from s group by family), w as (select family, n, k, k / n p, {evaluation.Z95!r}::double z from g) select family, round(greatest(0, least((p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n)), p)), 9) ci_low, round(least(1, greatest((p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n)), p)), 9) ci_high from w")
def wilson(spark, sf_dir):
    g = inputs.subjects(spark, sf_dir).groupBy("family").agg(F.count("*").cast("double").alias("n"), F.count_if("attacked").cast("double").alias("k"))
    low, high = evaluation.wilson_columns(F.col("k"), F.col("n"))
    return g.select("family", F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"))


_AUROC = "with {s}, r as (select {by} attacked, rank() over ({p} order by score) + (count(*) over ({q} score) - 1) / 2.0e0 rk from s), t as (select {by} count(*) filter (attacked) n_pos, count(*) filter (not attacked) n_neg, sum(rk) filter (attacked) w from r group by all) select {by} n_pos, n_neg, round((w - n_pos * (n_pos + 1) / 2.0e0) / (n_pos * n_neg), 9) auroc, round(2 * (w - n_pos * (n_pos + 1) / 2.0e0) / (n_pos * n_neg) - 1, 9) cliffs_delta from t"


@query("A48_auroc", _AUROC.format(s=_SUBJECTS, by="", p="", q="partition by"))
def auroc(spark, sf_dir):
    return evaluation.auroc(inputs.subjects(spark, sf_dir)).withColumn("auroc", F.round("auroc", 9)).withColumn("cliffs_delta", F.round("cliffs_delta", 9))


@query("A51_auroc_by_slice", _AUROC.format(s=_SUBJECTS, by="family, ", p="partition by family", q="partition by family,"))
def auroc_by_slice(spark, sf_dir):
    return evaluation.auroc(inputs.subjects(spark, sf_dir), ["family"]).withColumn("auroc", F.round("auroc", 9)).withColumn("cliffs_delta", F.round("cliffs_delta", 9))


@query("A49_threshold", f"with {_SUBJECTS}, b as (select min(score) lo, max(score) hi, count(*) filter (attacked) p, count(*) filter (not attacked) n from s), g as (select i, lo + (hi - lo) * i / 199 t, p, n from b, range(200) x(i)), r as (select i, t, count(*) filter (attacked and score >= t) / greatest(1, any_value(p)) tpr, count(*) filter (not attacked and score >= t) / greatest(1, any_value(n)) fpr from g, s group by all) select round(t, 9) threshold, round(tpr, 9) tpr, round(fpr, 9) fpr from r where fpr <= 0.05 order by tpr desc, i limit 1")
def threshold(spark, sf_dir):
    return evaluation.pick_threshold(inputs.subjects(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("threshold", "tpr", "fpr")))


@query("A50_leave_one_family_out", f"with {_SUBJECTS}, h as (select distinct family held from s where attacked), x as (select held, family, attacked, unnest(case when not attacked then ['train', 'test'] when family = held then ['test'] else ['train'] end) part from s, h) select held, part, count(*) n, count(*) filter (attacked) n_attacked from x group by all")
def leave_one_family_out(spark, sf_dir):
    return evaluation.leave_one_family_out(inputs.subjects(spark, sf_dir)).groupBy("held", "part").agg(F.count("*").alias("n"), F.count_if("attacked").alias("n_attacked"))


@query("A53_variance_decomposition", f"with {_SUBJECTS}, g as (select setting, avg(score) m, var_samp(score) v from s group by setting), o as (select var_samp(m) b, avg(v) w from g) select round(b, 4) as \"between\", round(w, 4) as \"within\", round(b / w, 6) ratio, b / w >= 4 sensitive from o")
def variance_decomposition(spark, sf_dir):
    v = evaluation.variance_decomposition(inputs.subjects(spark, sf_dir).select("setting", F.col("score").alias("value")))
    return v.select(F.round("between", 4).alias("between"), F.round("within", 4).alias("within"), F.round("ratio", 6).alias("ratio"), "sensitive")


@query("A54_scoreboard", f"with {_SUBJECTS} select detector_id, count(*) filter (attacked) n_attacked, count(*) filter (attacked and fired) detected, count(*) filter (not attacked) n_clean, count(*) filter (not attacked and fired) false_alarms, count(*) filter (attacked and fired) / count(*) filter (attacked) detection_rate, count(*) filter (not attacked and fired) / count(*) filter (not attacked) false_alarm_rate from s group by detector_id")
def scoreboard(spark, sf_dir):
    return evaluation.scoreboard(inputs.subjects(spark, sf_dir)).drop("ci_low", "ci_high")


@query("J27_mcnemar_counts", f"with {_SUBJECTS} select count(*) filter (right_a and not right_b) only_a, count(*) filter (not right_a and right_b) only_b from s")
def mcnemar_counts(spark, sf_dir):
    return evaluation.mcnemar(inputs.subjects(spark, sf_dir)).select("only_a", "only_b")


# ---- ledger ----

_LEDGER = f"l as materialized ({inputs.LEDGER_SQL})"
_LINK = "sha256(unhex('02') || rec::blob)"
_DAMAGED = f"d as materialized (select seq, rec, created_at, case when seq % 131 = 7 then 'x' else coalesce(lag({_LINK}) over (order by seq), repeat('0', 64)) end prev_hash from l where seq % 211 <> 13)"


def _damaged(spark, sf_dir):
    """The ledger with some rows missing, and some links that point nowhere."""
    kept = inputs.ledger(spark, sf_dir).where("seq % 211 <> 13").select("seq", "rec", "created_at")
    hashed = ledger.in_order(kept.withColumn("h", ledger.link_hash(F.col("rec"))), {"p": "h"})
    return hashed.select("seq", "rec", "created_at", F.when(F.col("seq") % 131 == 7, "x").otherwise(F.coalesce("p", F.lit(ledger.ZERO))).alias("prev_hash"))


@query("W02_broken_links", f"with {_LEDGER}, {_DAMAGED}, c as (select seq, prev_hash, lag({_LINK}) over (order by seq) expected from d) select seq, prev_hash, expected from c where prev_hash <> coalesce(expected, repeat('0', 64))")
def broken_links(spark, sf_dir):
    return ledger.check_links(_damaged(spark, sf_dir))


@query("W04_sequence_gaps", f"with {_LEDGER}, k as (select seq from l where seq % 211 <> 13 union all select seq from l where seq % 503 = 100), n as (select seq, count(*) n from k group by seq), b as (select seq, n, lag(seq, 1, -1) over (order by seq) p from n) select seq, 'gap' kind, seq - p - 1 missing from b where seq - p > 1 union all select seq, 'duplicate', n - 1 from b where n > 1")
def sequence_gaps(spark, sf_dir):
    l = inputs.ledger(spark, sf_dir).select("seq")
    return ledger.check_sequence(l.where("seq % 211 <> 13").unionByName(l.where("seq % 503 = 100")))


@query("W03_clock_regressions", f"with {_LEDGER}, t as (select seq, case when seq % 313 = 5 then created_at - interval 1 day else created_at end created_at from l), b as (select *, lag(created_at) over (order by seq) p from t) select seq from b where created_at < p")
def clock_regressions(spark, sf_dir):
    l = inputs.ledger(spark, sf_dir).select("seq", F.when(F.col("seq") % 313 == 5, F.col("created_at") - F.expr("interval 1 day")).otherwise(F.col("created_at")).alias("created_at"))
    return ledger.clock_regressions(l).select("seq")


@query("W05_repeated_nonces", f"with {_LEDGER}, i as (select *, coalesce(sum((type = 'anchor_event')::int) over (order by seq rows between unbounded preceding and 1 preceding), 0)::int as interval_no from l), u as (select seq, nonce, interval_no, (row_number() over (partition by interval_no, nonce order by seq))::int as use from i) select seq, nonce, interval_no as \"interval\", use from u where use > 1")
def repeated_nonces(spark, sf_dir):
    return ledger.repeated_nonces(inputs.ledger(spark, sf_dir))


@query("W06_registration_in_effect", f"with {_LEDGER} select seq, model_id, last_value(case when type = 'model_registration' then seq end ignore nulls) over (partition by model_id order by seq rows between unbounded preceding and 1 preceding) in_effect from l")
def registration_in_effect(spark, sf_dir):
    return ledger.in_effect(inputs.ledger(spark, sf_dir), "model_id", F.col("type") == "model_registration", "seq").select("seq", "model_id", "in_effect")


@query("W14_failure_runs", f"with {_LEDGER}, b as (select seq from l where seq % 50 between 3 and 6), g as (select seq, seq - row_number() over (order by seq) i from b) select min(seq) first_seq, max(seq) last_seq, count(*) n from g group by i")
def failure_runs(spark, sf_dir):
    return ledger.failure_runs(inputs.ledger(spark, sf_dir).select("seq", (F.col("seq") % 50).between(3, 6).alias("failed")))


@query("W16_unwitnessed", f"with {_LEDGER} select seq, type from l where seq > (select max(seq) from l where type = 'anchor_event')")
def unwitnessed(spark, sf_dir):
    return ledger.unwitnessed(inputs.ledger(spark, sf_dir)).select("seq", "type")


@query("A59_ledger_types", f"with {_LEDGER} select type, count(*) n from l group by type")
def ledger_types(spark, sf_dir):
    return inputs.ledger(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query("J18_moved_or_deleted", f"with {_LEDGER}, m as (select seq - 5 pos, seq from l where seq % 100 = 50), p as (select seq + case when seq % 200 = 50 then 3 else -9 end pos, seq from l) select m.seq, count(p.pos) later, case when count(p.pos) > 0 then 'reordered' else 'deleted' end kind from m left join p on m.seq = p.seq and p.pos > m.pos group by m.seq")
def moved_or_deleted(spark, sf_dir):
    l = inputs.ledger(spark, sf_dir).select("seq")
    return ledger.appears_later(l.select((F.col("seq") + F.when(F.col("seq") % 200 == 50, 3).otherwise(-9)).alias("pos"), "seq"), l.where("seq % 100 = 50").select((F.col("seq") - 5).alias("pos"), "seq"))


_LEAF = "sha256(unhex('00') || rec::blob)"


@query("A57_merkle_root", f"""with recursive {_LEDGER}, t(level, idx, hash) as (select 0, seq, {_LEAF} from l union all
  select level, idx, hash from (select level + 1 as level, idx // 2 idx, case when count(*) = 1 then min(case when idx % 2 = 0 then hash end) else sha256(unhex('01') || unhex(min(case when idx % 2 = 0 then hash end)) || unhex(min(case when idx % 2 = 1 then hash end))) end hash, count(*) over () n
  from t group by level, idx // 2) where (select count(*) from t) > 1) select max(level)::int as level, arg_max(hash, level) root from t""")
def merkle_root(spark, sf_dir):
    leaves = inputs.ledger(spark, sf_dir).select(F.col("seq").alias("idx"), ledger.leaf_hash(F.col("rec")).alias("hash"))
    return ledger.merkle_levels(leaves).agg(F.max("level").alias("level"), F.max_by("hash", "level").alias("root"))


# ---- governance ----


@query("L19_timeline", f"with {_LEDGER} select seq, type, case when type = 'analyst_event' then 'u' || user_id || ' ' || event_type || ' ' || model_id when type = 'scan_record' then 'scan ' || model_id || ' sealed' else replace(type, '_', ' ') end line from l")
def timeline(spark, sf_dir):
    l = inputs.ledger(spark, sf_dir).select("seq", "type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor_id"), F.col("event_type").alias("action"), F.col("model_id").alias("target_ref"))
    return governance.timeline(l)


@query("J20_seal_check", f"with {_LEDGER}, r as (select seq, model_id scan_id, sha256(rec) h from l where type = 'scan_record'), s as (select cast(i as varchar) scan_id from range(9) t(i)), f as (select scan_id, max(seq) m, arg_max(h, seq) sealed from r group by scan_id) select s.scan_id, sealed, m sealed_at, case when sealed is null then 'unsealed' when s.scan_id <> '3' then 'match' else 'mismatch' end seal from s left join f using (scan_id)")
def seal_check(spark, sf_dir):
    r = inputs.ledger(spark, sf_dir).where("type = 'scan_record'").select("seq", F.col("model_id").alias("scan_id"), F.sha2(F.col("rec").cast("binary"), 256).alias("report_sha256"))
    last = r.groupBy("scan_id").agg(F.max_by("report_sha256", "seq").alias("h"))
    files = spark.range(9).select(F.col("id").cast("string").alias("scan_id")).join(last, "scan_id", "left").select("scan_id", F.when(F.col("scan_id") == "3", "other").otherwise(F.coalesce("h", F.lit("none"))).alias("file_sha256"))
    return governance.seal_check(files, r).select("scan_id", "sealed", "sealed_at", "seal")


@query("L20_append_once", f"with {_LEDGER} select nonce request_id, min(seq) seq from l group by nonce")
def append_once(spark, sf_dir):
    return governance.once(inputs.ledger(spark, sf_dir).withColumnRenamed("nonce", "request_id")).select("request_id", "seq")


@query("J26_coverage_diff", "with c as (select type attack_class, case when side = 0 and n % 3 = 0 then 'no capability' when side = 1 and n % 4 = 0 then 'budget' end reason, side from (select p_type as type, p_size % 2 as side, count(*) n from part group by all)), a as (select attack_class, bool_or(reason is null) ok, max(reason) why from c where side = 0 group by all), b as (select attack_class, bool_or(reason is null) ok, max(reason) why from c where side = 1 group by all) select attack_class, case when coalesce(a.ok, false) and coalesce(b.ok, false) then 'both' when coalesce(a.ok, false) then 'only_left' when coalesce(b.ok, false) then 'only_right' else 'neither' end side, case when coalesce(a.ok, false) and not coalesce(b.ok, false) then coalesce(b.why, 'absent') end lost_reason from a full join b using (attack_class)")
def coverage_diff(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("attack_class"), (F.col("p_size") % 2).alias("side")).agg(F.count("*").alias("n"))
    c = g.withColumn("reason", F.when((F.col("side") == 0) & (F.col("n") % 3 == 0), "no capability").when((F.col("side") == 1) & (F.col("n") % 4 == 0), "budget"))
    return governance.coverage_diff(c.where("side = 0"), c.where("side = 1"))


@query("A42_coverage_matrix", "with k as (select p_brand detector_id, p_type attack_class, p_size % 5 > 0 ran from part), g as (select attack_class, list_sort(list(distinct detector_id) filter (ran)) assessed, list_sort(list(distinct detector_id) filter (not ran)) not_assessed from k group by all), t as (select distinct p_type attack_class from part) select attack_class, len(coalesce(assessed, [])) n_assessed, case when g.attack_class is null then 'never covered' when len(coalesce(assessed, [])) > 0 then 'assessed' else 'not assessed' end state from t left join g using (attack_class)")
def coverage_matrix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    checks = p.select(F.col("p_brand").alias("detector_id"), F.array("p_type").alias("attack_classes"), (F.col("p_size") % 5 > 0).alias("ran"))
    out = governance.coverage_matrix(checks, p.select(F.col("p_type").alias("attack_class")).distinct())
    return out.select("attack_class", F.size(F.coalesce("assessed", F.array().cast("array<string>"))).cast("long").alias("n_assessed"), "state")


@query("P09_capabilities", "with c as (select p_partkey, list_sort(list_distinct(['images', p_brand])) req, [p_type, 'labels'] opt from part), r as (select p_partkey, list_sort(list_filter(req, lambda x: x not in ('images', 'labels', 'Brand#11', 'Brand#12'))) need, list_sort(list_filter(opt, lambda x: x not in ('images', 'labels', 'Brand#11', 'Brand#12'))) want from c) select cast(p_partkey as varchar) detector_id, case when len(need) > 0 then 'unavailable' when len(want) > 0 then 'degraded' else 'ok' end availability, array_to_string(case when len(need) > 0 then need else want end, ',') missing from r")
def capabilities(spark, sf_dir):
    checks = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("detector_id"), F.array(F.lit("images"), F.col("p_brand")).alias("requires"), F.array(F.col("p_type"), F.lit("labels")).alias("optional"))
    return capability.resolve_table(checks, ["images", "labels", "Brand#11", "Brand#12"])


def _analyst_events(spark, sf_dir):
    """``events`` read as an analyst's: approvals name the event six before them, by another person or the same."""
    i = F.col("event_id")
    action = F.element_at(F.array(*(F.lit(a) for a in governance.ACTIONS)), (F.floor(i / 6) % 2 * 3 + i % 3 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(i.alias("seq"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("actor_id"), action.alias("action"), (i % 3).alias("place"), F.element_at(F.array(F.lit("quarantine"), F.lit("accept"), F.lit("review")), (i % 3 + 1).cast("int")).alias("new_disposition"), F.lit("u9").alias("assignee"), (F.floor(i / 12) % 400).cast("string").alias("target_ref"))
    return e.withColumn("refs_seq", F.when(F.col("action") == "approve", F.col("seq") - F.when(F.col("seq") % 2 == 0, 4).otherwise(5)).cast("long")).withColumn("target_type", F.lit("sample")).drop("place")


@query("L17_event_fold")
def event_fold(spark, sf_dir):
    events = _analyst_events(spark, sf_dir).join(_routed(spark, sf_dir).select("finding_id", "target_ref"), "target_ref")
    return governance.fold(_routed(spark, sf_dir).select("finding_id", "disposition"), events)


@query("L17_target_fold")
def target_fold(spark, sf_dir):
    return governance.fold_targets(_analyst_events(spark, sf_dir))


# ---- scalar functions ----


@query("F01_sha256", "select doc_id, sha256(coalesce(text, '')) digest from documents")
def sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))


@query("F08_quantise", "select l_orderkey, l_linenumber, floor(l_discount * 1000000 + 0.5)::bigint micro, floor(greatest(l_extendedprice, 1000) * 64 + 0.5)::bigint fine from lineitem")
def quantise(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.quantise(F.col("l_discount"), 1e6).alias("micro"), scalars.quantise(F.col("l_extendedprice"), 64, low=1000.0).alias("fine"))


@query("F11_entropy", "with p as (select l_orderkey, list(q / t order by n) p from (select l_orderkey, l_linenumber n, l_quantity q, sum(l_quantity) over (partition by l_orderkey) t from lineitem) group by l_orderkey) select l_orderkey, round(list_sum(list_transform(p, lambda x: -greatest(x, 1e-12) * log2(greatest(x, 1e-12)))), 6) entropy from p")
def entropy(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"), F.sum("l_quantity").alias("t"))
    return q.select("l_orderkey", F.round(scalars.entropy(F.transform("q", lambda x: x / F.col("t"))), 6).alias("entropy"))


@query("F12_softmax_top", "with p as (select o_custkey, list(o_totalprice / 100000 order by o_orderkey) x from orders group by o_custkey) select o_custkey, round(1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) top from p")
def softmax_top(spark, sf_dir):
    q = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_totalprice") / 100000).alias("x"))
    return q.select("o_custkey", F.round(F.array_max(scalars.softmax(F.col("x"))), 6).alias("top"))


@query("F20_rfc3339", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as created_at_utc from events")
def rfc3339(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.rfc3339(F.col("ts")).alias("created_at_utc"))


@query("F22_top_mean", "with p as (select o_custkey, list(o_totalprice order by o_totalprice desc) x from orders group by o_custkey) select o_custkey, round(list_avg(x[1:3]), 4) top_mean from p")
def top_mean(spark, sf_dir):
    q = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("x"))
    return q.select("o_custkey", F.round(scalars.top_mean(F.col("x"), 3), 4).alias("top_mean"))


@query("F23_dominant", "with c as (select l_orderkey, l_returnflag, count(*) n from lineitem group by all) select l_orderkey, first(l_returnflag order by n desc, l_returnflag) dominant from c group by l_orderkey")
def dominant(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("x"))
    return q.select("l_orderkey", scalars.dominant(F.col("x")).alias("dominant"))


@query("F16_sentence_case", "select p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) as name from part")
def sentence_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.sentence_case(F.col("p_name")).alias("name"))


# ---- boxes and loaders' projections ----


@query("P01_yolo_boxes", f"with b as ({inputs.BOXES_SQL}) select sample_id, det_id, round((x / 100 - w / 1000 / 2) * 640, 6) x, round((y / 100 - h / 1000 / 2) * 480, 6) y, round(w / 1000 * 640, 6) w, round(h / 1000 * 480, 6) h from b")
def yolo_boxes(spark, sf_dir):
    b = inputs.boxes(spark, sf_dir)
    made = b.withColumn("b", datasets.yolo_box(F.col("x") / 100, F.col("y") / 100, F.col("w") / 1000, F.col("h") / 1000, F.lit(640), F.lit(480)))
    return made.select("sample_id", "det_id", *(F.round(f"b.{c}", 6).alias(c) for c in "xywh"))


@query("P02_voc_boxes", f"with b as ({inputs.BOXES_SQL}) select sample_id, det_id, x - 1 x, y - 1 y, w + 1 w, h + 1 h from b")
def voc_boxes(spark, sf_dir):
    b = inputs.boxes(spark, sf_dir)
    made = b.withColumn("b", datasets.voc_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    return made.select("sample_id", "det_id", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.round("b.w", 6).alias("w"), F.round("b.h", 6).alias("h"))


ORACLES["P02_voc_boxes"] = f"with b as ({inputs.BOXES_SQL}) select sample_id, det_id, x - 1 x, y - 1 y, round(x + w - x + 1, 6) w, round(y + h - y + 1, 6) h from b"


@query("P03_annotations", "select cast(l_orderkey as varchar) || ':' || (row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) - 1) annotation_id, cast(l_orderkey as varchar) sample_id, l_suppkey::int category_id from lineitem")
def annotations(spark, sf_dir):
    label = F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").cast("int").alias("category_id"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sample_id")).agg(F.array_sort(F.collect_list(label)).alias("l"))
    empty = {c: F.lit(0.0).alias(c) for c in "xywh"}
    labels = F.transform("l", lambda v: F.struct(v["category_id"].alias("category_id"), *empty.values(), F.lit(False).alias("iscrowd"), F.lit(None).cast("string").alias("label_id")))
    return datasets.annotations(s.select("sample_id", labels.alias("labels"))).select("annotation_id", "sample_id", "category_id")


@query("P04_dense_categories", "with c as (select distinct case when p_size % 2 = 0 then cast(p_size as varchar) else p_brand end source_id from part) select source_id, (dense_rank() over (order by try_cast(source_id as bigint) is null, try_cast(source_id as bigint), source_id) - 1)::int as category_id from c")
def dense_categories(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("source_id"))
    return datasets.dense_categories(c)


# ---- models, from given predictions and weights ----


@query("A33_weight_moments", "with m as (select l_returnflag layer, avg(l_extendedprice) mean, stddev_pop(l_extendedprice) std, kurtosis_pop(l_extendedprice) k, max(abs(l_extendedprice)) top from lineitem group by all) select layer, round(mean, 3) mean, round(std, 3) std, round(any_value(k), 6) kurtosis, any_value(top) max_abs, avg(case when abs(l_extendedprice - mean) > 2 * std then 1.0e0 else 0.0e0 end) tail from lineitem join m on l_returnflag = layer group by layer, mean, std")
def weight_moments(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("layer"), F.col("l_extendedprice").alias("w"))
    m = models.weight_moments(w, sigmas=2.0)
    return m.select("layer", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), F.round("kurtosis", 6).alias("kurtosis"), "max_abs", "tail")


@query("A35_noise_prior", "select o_orderpriority predicted, count(*) / sum(count(*)) over () as share from orders group by o_orderpriority")
def noise_prior(spark, sf_dir):
    return models.noise_prior(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("predicted")))


@query("A36_confusion_asymmetry", f"with p as ({inputs.PREDICTIONS_SQL}), n as (select label, count(*) n from p group by all), r as (select label, predicted, count(*) / any_value(n) r from p join n using (label) where label <> predicted group by all), i as (select predicted c, sum(r) x from r group by all), o as (select label c, sum(r) x from r group by all) select n.label, round(coalesce(i.x, 0) - coalesce(o.x, 0), 9) asymmetry from n left join i on i.c = n.label left join o on o.c = n.label")
def confusion_asymmetry(spark, sf_dir):
    return models.confusion_asymmetry(inputs.predictions(spark, sf_dir)).select("label", F.round("asymmetry", 9).alias("asymmetry"))


@query("A38_class_collapse", f"with p as ({inputs.PREDICTIONS_SQL}), c as (select predicted, count(*) n from p group by all) select (select avg(case when label = predicted then 1.0e0 else 0.0e0 end) from p) accuracy, count(*) used_classes, max(n) / sum(n) top_share from c")
def class_collapse(spark, sf_dir):
    return models.class_collapse(inputs.predictions(spark, sf_dir))


@query("A40_fingerprint_divergence", "with d as (select avg(abs(a.l_discount - b.l_discount)) d from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2) select round(d, 9) divergence, case when d < 0.01 then 'same' when d < 0.05 then 'close' else 'different' end band from d")
def fingerprint_divergence(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("probe"), "l_linenumber", F.col("l_discount").alias("value"))
    out = models.fingerprint_divergence(l.where("l_linenumber = 1"), l.where("l_linenumber = 2"))
    return out.withColumn("divergence", F.round("divergence", 9))


@query("J24_dead_tensors", "with e as (select ps.l_orderkey % 500 node, 't' || (l_partkey % 700) o, 't' || (l_suppkey % 300) i from lineitem ps) select distinct o as tensor from e where o not in (select i from e) and o not in ('t1', 't2', 't601')")
def dead_tensors(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return models.dead_tensors(l.select(F.concat(F.lit("t"), (F.col("l_partkey") % 700).cast("string")).alias("tensor")), l.select(F.concat(F.lit("t"), (F.col("l_suppkey") % 300).cast("string")).alias("tensor")), ["t1", "t2", "t601"])


@query("M11_claim_ladder", "select case when l_discount = l_tax and l_quantity % 2 = 0 then 'R0' when round(l_discount, 1) = round(l_tax, 1) then 'R1' when abs(l_discount - l_tax) <= 0.05 then 'R2' else 'R3' end level, count(*) n from lineitem group by all")
def claim_ladder(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    rows = l.select((F.col("l_discount") == F.col("l_tax")).alias("same_value"), (F.col("l_quantity") % 2 == 0).alias("same_runtime"), (F.round("l_discount", 1) == F.round("l_tax", 1)).alias("same_coarse"), (F.abs(F.col("l_discount") - F.col("l_tax")) <= 0.05).alias("near"))
    return rows.select(models.claim_level().alias("level")).groupBy("level").agg(F.count("*").alias("n"))
