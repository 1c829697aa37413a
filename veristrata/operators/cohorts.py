"""Tests of groups against their peers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.functions import stats
from veristrata.operators.running import quantiles
from veristrata.sources.session import cut

MAD_SCALE = 1.4826


def robust_z(rows: DataFrame, by: list[str], value: str, floor: float = 0.1) -> DataFrame:
    """``z``: distance from the group's median in scaled MADs, the MAD kept from zero by ``floor``."""
    middle = quantiles(rows, value, [0.5], by).select(*by, F.get("quantiles", F.lit(0)).alias("__m"))
    one = rows.join(middle, by, "left")
    spread = quantiles(one.withColumn("__d", F.abs(F.col(value) - F.col("__m"))), "__d", [0.5], by).select(*by, (F.get("quantiles", F.lit(0)) * MAD_SCALE).alias("__s"))
    return one.join(spread, by, "left").withColumn("z", (F.col(value) - F.col("__m")) / F.greatest("__s", F.lit(floor))).drop("__m", "__s")


def mad_index(rows: DataFrame, value: str = "value") -> DataFrame:
    """How far each value lies below the median: (median - x) / max(MAD, 5 % of the median, 1e-9)."""
    middle = quantiles(rows, value, [0.5]).first()
    if middle is None:
        return rows.withColumn("anomaly_index", F.lit(None).cast("double"))
    m = middle["quantiles"][0]
    s = quantiles(rows.select(F.abs(F.col(value) - m).alias("d")), "d", [0.5]).first()["quantiles"][0] * MAD_SCALE
    return rows.withColumn("anomaly_index", (F.lit(m) - F.col(value)) / max(s, m * 0.05, 1e-9))


def top_share(rows: DataFrame, by: str, value: str) -> DataFrame:
    """A group's most common non-null value (ties to the smallest) and its share of the non-null ones."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.min_by(value, F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v"))).alias("top_value"), (F.max("n") / F.sum("n")).alias("share"))


def burst_share(rows: DataFrame, by: str, time: str, gap: float = 0.05) -> DataFrame:
    """Share of consecutive gaps shorter than ``gap`` seconds; 0 for fewer than three rows. ``time``: seconds."""
    w = Window.partitionBy(by).orderBy(time)
    gaps = rows.withColumn("__gap", F.col(time) - F.lag(time).over(w))
    return gaps.groupBy(by).agg(F.when(F.count("*") < 3, F.lit(0.0)).otherwise(F.avg((F.col("__gap") < gap).cast("double"))).alias("burst_share"), F.count("*").alias("n"))


def group_key(rows: DataFrame, least: int = 20) -> DataFrame:
    """``group_key`` and ``group_type``: contributor, else batch, else the whole; only groups of ``least`` rows or more."""
    c, b = F.nullif(F.col("contributor"), F.lit("")), F.nullif(F.col("batch"), F.lit(""))
    keyed = rows.withColumn("group_key", F.coalesce(c, b, F.lit("all"))).withColumn("group_type", F.when(c.isNotNull(), "contributor").when(b.isNotNull(), "batch").otherwise("dataset"))
    size = keyed.groupBy("group_type", "group_key").agg(F.count("*").alias("group_n")).where(F.col("group_n") >= least)
    return keyed.join(size, ["group_type", "group_key"])


def share_against_rest(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    """A group's share of a flag against that of all other rows: totals less the group's own, no join of groups."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(flag).alias("k"))
    every = Window.partitionBy()  # one short row a group
    return g.withColumn("all_n", F.sum("n").over(every)).withColumn("all_k", F.sum("k").over(every)).select(by, "n", "k", (F.col("k") / F.col("n")).alias("share"), F.try_divide(F.col("all_k") - F.col("k"), F.col("all_n") - F.col("n")).alias("rest_share"))


def others_max(rows: DataFrame, by: str, value: str) -> DataFrame:
    """For each group, the largest ``value`` among the other groups, from the two largest alone."""
    every = Window.partitionBy()  # one short row a group
    return rows.withColumn("top", F.slice(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("neg"), F.col(by).alias("g"))).over(every)), 1, 2)).withColumn("others_max", F.when(F.col("top")[0]["g"] == F.col(by), -F.get(F.col("top"), F.lit(1))["neg"]).otherwise(-F.col("top")[0]["neg"])).drop("top")


def confusion_cells(rows: DataFrame) -> DataFrame:
    """Of every contributor and class: ``n``, and how often each other class was predicted. ``rows``: contributor, label, predicted."""
    n = rows.groupBy("contributor", "label").agg(F.count("*").alias("n"))
    cells = rows.where("label <> predicted").groupBy("contributor", "label", "predicted").agg(F.count("*").alias("hits"))
    return cells.join(n, ["contributor", "label"]).withColumn("rate", F.col("hits") / F.col("n"))


def mislabel_tests(rows: DataFrame, least_rate: float = 0.25, lead: float = 0.2, alpha: float = 0.01) -> DataFrame:
    """Cells whose rate is high, leads the worst peer's, and is significant after Bonferroni over all cells."""
    cells = confusion_cells(rows)
    n = rows.groupBy("contributor", "label").agg(F.count("*").alias("n"))
    top = n.join(cells.select("contributor", "label", "predicted", "rate", "hits"), ["contributor", "label"]).groupBy("label", "predicted").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("rate")).alias("neg"), "contributor"))), 1, 2).alias("top"), F.sum("hits").alias("all_hits"))
    peers = n.groupBy("label").agg(F.sum("n").alias("all_n"), F.count("*").alias("contributors"))
    both = cells.join(top, ["label", "predicted"]).join(peers, "label")
    worst = F.coalesce(F.when(F.col("top")[0]["contributor"] == F.col("contributor"), -F.get(F.col("top"), F.lit(1))["neg"]).otherwise(-F.col("top")[0]["neg"]), F.lit(0.0))
    tested = both.withColumn("worst_peer", worst).withColumn("peer_hits", F.col("all_hits") - F.col("hits")).withColumn("peer_n", F.col("all_n") - F.col("n")).drop("top")
    family = tested.count()

    @F.pandas_udf("double")
    def p(a: pd.Series, n_: pd.Series, c: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([stats.fisher_greater(int(w), int(x - w), int(y), int(z - y)) for w, x, y, z in zip(a, n_, c, m, strict=True)])

    out = tested.withColumn("p", F.least(F.lit(1.0), p("hits", "n", "peer_hits", "peer_n") * family))
    return out.withColumn("flagged", (F.col("rate") >= least_rate) & (F.col("rate") - F.col("worst_peer") >= lead) & (F.col("p") < alpha) & (F.col("contributors") > 1))


#: The least spread that counts for each box feature; places are shares of the image's sides.
SPREAD_FLOORS = {"log_area": 0.05, "log_aspect": 0.03, "cx": 0.02, "cy": 0.02}
#: Ranges of values into which a feature's rows are dealt for running counts.
RANGES = 64


def box_features(boxes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Long form of a box's log area, log aspect and centre: contributor, category, feature, value. Boxes: x, y, w, h as shares of the image's sides."""
    ok = boxes.where("w > 0 and h > 0")
    pairs = F.array(
        F.struct(F.lit("log_area").alias("feature"), F.ln(F.col("w") * F.col("h")).alias("value")),
        F.struct(F.lit("log_aspect").alias("feature"), F.ln(F.col("w") / F.col("h")).alias("value")),
        F.struct(F.lit("cx").alias("feature"), (F.col("x") + F.col("w") / 2).alias("value")),
        F.struct(F.lit("cy").alias("feature"), (F.col("y") + F.col("h") / 2).alias("value")),
    )
    names = ["contributor", "category", *(keep or [])]
    return ok.select(*names, F.explode(pairs).alias("f")).select(*names, "f.feature", "f.value")


def value_counts(features: DataFrame) -> DataFrame:
    """Box features with how often each contributor has a value: category, feature, contributor, value, ``k``. Null values are left out. Boxes are read once, by whatever asks of it."""
    return cut(features.where("value is not null").groupBy("category", "feature", "contributor", "value").agg(F.count("*").alias("k")))


def geometry_shift(features: DataFrame, least: int = 15, effect: float = 1.0) -> DataFrame:
    """Median and spread of each contributor's boxes by category and feature, and on which side of every peer it stands.

    ``side`` is 1 (-1) if the median lies ``effect`` of the peer's spreads or more
    above (below) every other contributor's median, else 0; null without a peer.
    The extreme bound of the others is the first or second of an ordered window of
    one short row a contributor, so no contributors are paired.
    """
    return shift_of_counts(value_counts(features), least, effect)


def shift_of_counts(counted: DataFrame, least: int = 15, effect: float = 1.0) -> DataFrame:
    """``geometry_shift`` from ``value_counts``; medians are found in ranges of values, so no task holds a contributor's."""
    by = ["category", "feature", "contributor"]
    n = counted.groupBy(*by).agg(F.sum("k").alias("n")).where(F.col("n") >= least)
    middle = n.join(quantiles(counted, "value", [0.5], by, "k").select(*by, F.col("quantiles")[0].alias("median")), by)
    floor = F.coalesce(*(F.when(F.col("feature") == name, F.lit(v)) for name, v in SPREAD_FLOORS.items()), F.lit(0.0))
    away = counted.join(middle, by).select(*by, F.abs(F.col("value") - F.col("median")).alias("away"), "k")
    spread = quantiles(away, "away", [0.5], by, "k").select(*by, (F.col("quantiles")[0] * MAD_SCALE).alias("spread"))
    g = middle.join(spread, by).withColumn("spread", F.greatest("spread", floor))
    high, low = F.col("median") + effect * F.col("spread"), F.col("median") - effect * F.col("spread")

    def others(bound: Column, order: Column) -> Column:
        w = Window.partitionBy("category", "feature").orderBy(order, "contributor")
        return F.when(F.row_number().over(w) == 1, F.lead(bound).over(w)).otherwise(F.first(bound).over(w))

    peers = F.count("*").over(Window.partitionBy("category", "feature")) - 1
    marked = g.withColumn("others_high", others(high, F.desc(high))).withColumn("others_low", others(low, F.asc(low))).withColumn("peers", peers)
    side = F.when(F.col("peers") == 0, F.lit(None)).when(F.col("median") >= F.col("others_high"), 1).when(F.col("median") <= F.col("others_low"), -1).otherwise(0)
    return marked.select(*by, "n", "median", "spread", "peers", side.alias("side"))


def ecdf_against_peers(counted: DataFrame, chosen: DataFrame) -> DataFrame:
    """Two-sample KS statistic of each chosen contributor against each peer: category, feature, contributor, peer, ks.

    Running counts are made inside ranges of values and carried over by one short
    row a range, so no task orders a whole feature. A chosen contributor's counts
    are read where a peer's step, at the step and just before it: between two
    steps of the peer the distance is largest at an end. ``counted``: ``value_counts``.
    """
    key = ["category", "feature"]
    wanted = chosen.select(*key, F.col("contributor").alias("target"))
    some = counted.join(wanted.select(*key).distinct(), key)
    bounds = some.groupBy(*key).agg(F.percentile_approx("value", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), F.lit(1000)).alias("bounds"))
    each = some.join(bounds, key)
    each = each.select(*key, "contributor", "value", "k", F.size(F.filter("bounds", lambda b: b <= F.col("value"))).alias("range"))
    rows = each.join(wanted, key).withColumn("own", F.when(F.col("contributor") == F.col("target"), F.col("k")).otherwise(0))
    inside = Window.partitionBy(*key, "target", "range").orderBy("value")
    to, at = F.sum("own").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("own").over(inside.rangeBetween(Window.currentRow, Window.currentRow))
    mine = F.sum("k").over(Window.partitionBy(*key, "target", "range", "contributor").orderBy("value"))
    steps = rows.withColumn("to", to).withColumn("at", at).withColumn("mine", mine)
    # what lies in the ranges before: one row a range and contributor
    short = each.groupBy(*key, "range", "contributor").agg(F.sum("k").alias("k"))
    before = Window.partitionBy(*key, "contributor").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    carried = short.select(*key, "range", "contributor", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("mine_before"))
    size = short.groupBy(*key, "contributor").agg(F.sum("k").alias("size"))
    target = short.withColumnRenamed("contributor", "target").join(wanted, [*key, "target"])
    # a target needn't have rows in every range
    ranges = short.select(*key, "range").distinct().join(wanted, key).join(target, [*key, "target", "range"], "left").fillna(0, ["k"])
    held = Window.partitionBy(*key, "target").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*key, "target", "range", F.coalesce(F.sum("k").over(held), F.lit(0)).alias("to_before"))
    target_size = size.select(*key, F.col("contributor").alias("target"), F.col("size").alias("target_size"))
    full = steps.where("contributor <> target").join(carried, [*key, "range", "contributor"]).join(ranges, [*key, "target", "range"]).join(size, [*key, "contributor"]).join(target_size, [*key, "target"])
    theirs, ours = F.col("mine_before") + F.col("mine"), F.col("to_before") + F.col("to")
    gap = F.greatest(F.abs(ours / F.col("target_size") - theirs / F.col("size")), F.abs((ours - F.col("at")) / F.col("target_size") - (theirs - F.col("k")) / F.col("size")))
    return full.groupBy(*key, F.col("target").alias("contributor"), F.col("contributor").alias("peer")).agg(F.max(gap).alias("ks"))


def geometry_tests(features: DataFrame, least: int = 15, effect: float = 1.0, alpha: float = 1e-3) -> DataFrame:
    """Contributors whose boxes of a category lie to one side of every peer's, with a KS test against each peer.

    The weakest of a contributor's p-values, times the number of (contributor,
    category, feature) groups that have a peer, has to stay below ``alpha``.
    ``shift``, ``peer_median`` and ``peer_spread`` are the nearest peer's. At most
    one contributor stands above and one below all others of a category and
    feature, so rows grow with contributors and not with their pairs.
    """
    key = ["category", "feature"]
    counted = value_counts(features)
    g = cut(shift_of_counts(counted, least, effect).where("peers > 0"))
    family = g.count()
    chosen = g.where("side <> 0")
    usable = counted.join(g.select(*key, "contributor"), [*key, "contributor"])
    near = g.select(*key, F.col("contributor").alias("peer"), F.col("n").alias("peer_n"), F.col("median").alias("peer_median"), F.col("spread").alias("peer_spread"))

    @F.pandas_udf("double")
    def p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([stats.ks_p_value(x, int(y), int(z))[0] for x, y, z in zip(d, n, m, strict=True)])

    both = ecdf_against_peers(usable, chosen).join(chosen, [*key, "contributor"]).join(near, [*key, "peer"])
    both = both.withColumn("shift", (F.col("median") - F.col("peer_median")) / F.col("peer_spread")).withColumn("p", p("ks", "n", "peer_n"))
    closest = F.min_by(F.struct("shift", "peer", "peer_median", "peer_spread"), F.struct(F.abs("shift"), "peer")).alias("nearest")
    tested = both.groupBy(*key, "contributor", "n", "median", "side", "peers").agg(closest, F.max("p").alias("weakest"))
    adjusted = F.least(F.lit(1.0), F.col("weakest") * family)
    return tested.select(*key, "contributor", "n", "median", "side", "peers", "nearest.*", adjusted.alias("p_adjusted"), (adjusted < alpha).alias("flagged"))


def geometry_hits(features: DataFrame, tests: DataFrame, least_z: float = 1.5) -> DataFrame:
    """Samples with a box in the tail of a flagged shift: ``features`` (list), ``z`` (largest), severity, confidence. ``features``: sample_id too."""
    key = ["category", "feature", "contributor"]
    # two contributors of a category and feature at most, so that boxes needn't be shuffled to meet them
    flagged = tests.where("flagged").select(*key, "side", "peer_median", "peer_spread")
    far = features.join(F.broadcast(flagged), key).withColumn("z", F.col("side") * (F.col("value") - F.col("peer_median")) / F.col("peer_spread")).where(F.col("z") >= least_z)
    out = far.groupBy("sample_id").agg(F.array_sort(F.collect_set("feature")).alias("features"), F.max("z").alias("z"))
    confidence = F.least(F.lit(0.7), 0.3 + 0.1 * F.size("features") + 0.02 * F.least("z", F.lit(10.0)))
    return out.withColumn("severity", F.when(F.size("features") > 1, "medium").otherwise("low")).withColumn("confidence", confidence)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes whose columns are ``a.x`` ... ``b.h``."""
    w = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.x") + F.col(f"{a}.w"), F.col(f"{b}.x") + F.col(f"{b}.w")) - F.greatest(F.col(f"{a}.x"), F.col(f"{b}.x")))
    h = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.y") + F.col(f"{a}.h"), F.col(f"{b}.y") + F.col(f"{b}.h")) - F.greatest(F.col(f"{a}.y"), F.col(f"{b}.y")))
    return F.coalesce(F.try_divide(w * h, F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - w * h), F.lit(0.0))


def unmatched_detections(detections: DataFrame, boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """Detections that overlap no box of their sample by ``least``; a sample without boxes counts. Both: sample_id, x, y, w, h; detections also det_id."""
    d, b = detections.alias("d"), boxes.alias("b")
    return d.join(b, (F.col("d.sample_id") == F.col("b.sample_id")) & (iou("d", "b") >= least), "left_anti")
