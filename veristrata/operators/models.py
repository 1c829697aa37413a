"""Checks of models over tables of weights, predictions and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight_moments(weights: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Mean, population deviation, excess kurtosis, largest magnitude and tail share by layer. ``weights``: layer, w."""
    m = weights.groupBy("layer").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.kurtosis("w").alias("kurtosis"), F.max(F.abs("w")).alias("max_abs"))
    tail = weights.join(m.select("layer", "mean", "std"), "layer").groupBy("layer").agg(F.avg((F.abs(F.col("w") - F.col("mean")) > F.col("std") * sigmas).cast("double")).alias("tail"))
    return m.join(tail, "layer")


def against_battery(moments: DataFrame, battery: DataFrame) -> DataFrame:
    """z of each layer's kurtosis against known models' layers of the same name."""
    g = battery.groupBy("layer").agg(F.avg("kurtosis").alias("b_mean"), F.stddev_pop("kurtosis").alias("b_std"))
    return moments.join(g, "layer").withColumn("z", F.try_divide(F.col("kurtosis") - F.col("b_mean"), F.col("b_std")))


def activation_stats(activations: DataFrame) -> DataFrame:
    """Dead units and saturation by layer. ``activations``: layer, unit, value (probe rows)."""
    top = activations.groupBy("layer").agg(F.percentile("value", 0.999).alias("p999"))
    unit = activations.join(top, "layer").groupBy("layer", "unit").agg(F.max("value").alias("m"), F.avg((F.col("value") >= F.col("p999")).cast("double")).alias("sat"))
    return unit.groupBy("layer").agg(F.avg((F.col("m") <= 0).cast("double")).alias("dead_share"), F.max("sat").alias("saturation"), F.max("m").alias("top"))


def noise_prior(predictions: DataFrame) -> DataFrame:
    """Share of each class among predictions on noise."""
    g = predictions.groupBy("predicted").agg(F.count("*").alias("n"))
    return g.select("predicted", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def confusion_asymmetry(predictions: DataFrame) -> DataFrame:
    """Row-normalised inflow less outflow of each class. ``predictions``: label, predicted."""
    n = predictions.groupBy("label").agg(F.count("*").alias("n"))
    r = predictions.where("label <> predicted").groupBy("label", "predicted").agg(F.count("*").alias("k")).join(n, "label").withColumn("r", F.col("k") / F.col("n"))
    into, out = r.groupBy(F.col("predicted").alias("label")).agg(F.sum("r").alias("i")), r.groupBy("label").agg(F.sum("r").alias("o"))
    return n.join(into, "label", "left").join(out, "label", "left").select("label", (F.coalesce("i", F.lit(0.0)) - F.coalesce("o", F.lit(0.0))).alias("asymmetry"))


def top_suspects(asymmetry: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` classes that draw most from others; ties to the smaller label."""
    return asymmetry.orderBy(F.desc("asymmetry"), "label").limit(k)


def class_collapse(predictions: DataFrame) -> DataFrame:
    g = predictions.groupBy("predicted").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("right"))
    return g.agg((F.sum("right") / F.sum("n")).alias("accuracy"), F.count("*").alias("used_classes"), (F.max("n") / F.sum("n")).alias("top_share"))


def strip_entropy(overlays: DataFrame, clean: DataFrame, quantile: float = 0.01) -> DataFrame:
    """Share of inputs whose mean prediction entropy under overlays lies below the clean inputs' quantile. Both: input_id, probs."""
    from veristrata.functions.scalars import entropy

    limit = clean.groupBy("input_id").agg(F.avg(entropy(F.col("probs"))).alias("h")).agg(F.percentile("h", quantile)).first()[0]
    each = overlays.groupBy("input_id").agg(F.avg(entropy(F.col("probs"))).alias("h"))
    return each.withColumn("low", F.col("h") < F.lit(limit))


def fingerprint_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute difference over shared probes, and its band. Each: probe, value."""
    d = a.select("probe", F.col("value").alias("va")).join(b.select("probe", F.col("value").alias("vb")), "probe").agg(F.avg(F.abs(F.col("va") - F.col("vb"))).alias("divergence"))
    return d.withColumn("band", F.when(F.col("divergence") < 0.01, "same").when(F.col("divergence") < 0.05, "close").otherwise("different"))


def dead_tensors(produced: DataFrame, consumed: DataFrame, outputs: list[str]) -> DataFrame:
    """Tensors that nothing reads and that aren't outputs. Each: tensor."""
    return produced.select("tensor").distinct().where(~F.col("tensor").isin(*outputs)).join(consumed.select("tensor").distinct(), "tensor", "left_anti")


def claim_level() -> Column:
    """How well a record was recomputed: same bytes on the same runtime, same coarse output, within tolerance, or not."""
    return F.when(F.col("same_value") & F.col("same_runtime"), "R0").when(F.col("same_coarse"), "R1").when(F.col("near"), "R2").otherwise("R3")


def digest(weights: DataFrame) -> DataFrame:
    """One digest of a model's layers: hashes by layer, then over layers in order. ``weights``: layer, data (binary)."""
    each = weights.select("layer", F.sha2("data", 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "h"))), lambda x: F.concat(x["layer"], F.lit("\x1f"), x["h"])), "\x1e").cast("binary"), 256).alias("digest"))
