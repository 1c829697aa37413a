"""Drift between a reference and an incoming batch: stability index, ECDF distance, centroids, and the decision over many axes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions import stats
from veristrata.operators.running import beside, quantiles, running
from veristrata.sources.session import cut

#: Deciles cut the pooled values.
QUANTILES = [i / 10 for i in range(1, 10)]


def bin_edges(values: DataFrame) -> DataFrame:
    """Inner edges of an axis: the different pooled deciles, exact linear interpolation. ``values``: axis, batch, value."""
    return quantiles(values, "value", QUANTILES, ["axis"]).select("axis", F.array_sort(F.array_distinct("quantiles")).alias("edges"))


def bin_counts(values: DataFrame) -> DataFrame:
    """Counts of reference (batch 0) and incoming (batch 1) rows by axis and bin; bins are closed on the left, empty ones are absent."""
    binned = values.join(beside(bin_edges(values)), "axis").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    return binned.groupBy("axis", "bin").agg(F.count_if(F.col("batch") == 0).alias("n_ref"), F.count_if(F.col("batch") == 1).alias("n_inc"))


def stability_index(values: DataFrame) -> DataFrame:
    """PSI by axis with half a count added to each bin: ``axis``, ``psi``, ``bins``, ``n_ref``, ``n_inc``."""
    return stability_of(cut(bin_counts(values)))


def stability_of(c: DataFrame) -> DataFrame:
    """The same of counts by axis and bin."""
    whole = c.groupBy("axis").agg(F.sum("n_ref").alias("n"), F.sum("n_inc").alias("m"), F.count("*").alias("bins"))
    p = (F.col("n_ref") + 0.5) / (F.col("n") + 0.5 * F.col("bins"))
    q = (F.col("n_inc") + 0.5) / (F.col("m") + 0.5 * F.col("bins"))
    return c.join(whole, "axis").groupBy("axis").agg(F.sum((p - q) * F.ln(p / q)).alias("psi"), F.first("bins").alias("bins"), F.first("n").alias("n_ref"), F.first("m").alias("n_inc"))


def ks_statistic(values: DataFrame) -> DataFrame:
    """Largest distance of the two ECDFs, by axis. Equal values are combined first, so ties step together; running counts go over ranges of values."""
    each = values.groupBy("axis", "value").agg(F.count_if(F.col("batch") == 0).alias("r"), F.count_if(F.col("batch") == 1).alias("i"))
    total = beside(each.groupBy("axis").agg(F.sum("r").alias("n"), F.sum("i").alias("m")))
    steps = running(each, ["value"], {"cr": ("sum", F.col("r")), "ci": ("sum", F.col("i"))}, ["axis"]).join(total, "axis")
    return steps.groupBy("axis").agg(F.max(F.abs(F.col("cr") / F.col("n") - F.col("ci") / F.col("m"))).alias("ks"), F.first("n").alias("n_ref"), F.first("m").alias("n_inc"))


def adjust_bh(p_values: DataFrame, family: str | None = None) -> DataFrame:
    """Benjamini-Hochberg: ``q`` beside ``p``. ``p_values``: name, p (and a family column)."""
    by = [family] if family else []
    ranked = running(p_values, ["p", "name"], {"rank": ("sum", F.lit(1))}, by).withColumn("rank", F.col("rank").cast("int"))
    # the smallest scaled value from a rank upwards; sizes are those of the last ranks
    if family:
        size = ranked.groupBy(family).agg(F.max("rank").alias("__n")).withColumnRenamed(family, "__family")
        sized = ranked.join(size, F.col(family).eqNullSafe(F.col("__family"))).drop("__family")
    else:
        sized = ranked.withColumn("__n", F.lit(ranked.agg(F.max("rank")).first()[0]))
    back = running(sized, ["p", "name"], {"__least": ("min", F.col("p") * F.col("__n") / F.col("rank"))}, by, backward=True)
    return back.withColumn("q", F.least(F.lit(1.0), F.col("__least"))).drop("__least", "__n")


def axis_summary(values: DataFrame) -> DataFrame:
    return values.groupBy("axis", "batch").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def centroid_distance(reference: DataFrame, incoming: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Euclidean and diagonal Mahalanobis distance of the two centroids. Inputs hold ``vector``."""

    def per_dim(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias(f"mean_{name}"), F.var_samp("x").alias(f"var_{name}"))

    both = per_dim(reference, "r").join(per_dim(incoming, "i"), "dim")
    d = F.col("mean_r") - F.col("mean_i")
    return both.agg(F.sqrt(F.sum(d * d)).alias("euclid"), F.sqrt(F.sum(d * d / F.greatest(F.coalesce("var_r", F.lit(0.0)), F.lit(floor)))).alias("mahalanobis"))


def projections(vectors: DataFrame, axes: int = 16, seed: int = 0) -> DataFrame:
    """Random Gaussian projections to ``axes`` unit directions (the parts themselves if there are no more): id, axis, value. Built-in functions only."""
    first = vectors.select(F.size("vector").alias("d")).where("d > 0").first()
    dim = int(first["d"]) if first else 0
    if dim <= axes:
        return vectors.select("id", F.posexplode("vector").alias("axis", "value")).withColumn("value", F.col("value").cast("double"))
    basis = np.random.default_rng(seed).normal(size=(axes, dim))
    basis /= np.linalg.norm(basis, axis=1, keepdims=True)
    dots = F.array(*(F.aggregate(F.zip_with("vector", F.array(*(F.lit(float(b)) for b in row)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for row in basis))
    return vectors.select("id", F.posexplode(dots).alias("axis", "value"))


def unmatched_axes(reference: DataFrame, incoming: DataFrame) -> DataFrame:
    """Axes that one batch has alone: ``axis``, ``only_in``."""
    r, i = reference.select("axis").distinct(), incoming.select("axis").distinct()
    return r.join(i, "axis", "left_anti").withColumn("only_in", F.lit("reference")).unionByName(i.join(r, "axis", "left_anti").withColumn("only_in", F.lit("incoming")))


def overlap(reference: DataFrame, incoming: DataFrame) -> bool:
    """Any content shared? Then the batches can't be compared. Both hold ``content``."""
    return not reference.select("content").join(incoming.select("content"), "content", "left_semi").limit(1).isEmpty()


def assess(values: DataFrame, alpha: float = 0.01, effect: float = 0.1, seed: int = 0) -> DataFrame:
    """Every axis's tests, corrected over the family, and whether the shift is material. ``values``: axis, batch, value.

    Statistics are distributed; p-values are worked out on one row an axis.
    """
    counts = cut(bin_counts(values))
    found = stability_of(counts).join(ks_statistic(values).drop("n_ref", "n_inc"), "axis")
    low = counts.groupBy("axis").agg(F.collect_list(F.struct("bin", "n_ref", "n_inc")).alias("cells"))

    def p_values(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples():
                cells = sorted((c["bin"], c["n_ref"], c["n_inc"]) for c in row.cells)
                ref, inc = [c[1] for c in cells], [c[2] for c in cells]
                n, m = sum(ref), sum(inc)
                small = min(min(n, m) * (a + b) / max(1, n + m) for a, b in zip(ref, inc, strict=True)) < 5
                psi_p = stats.psi_permutation_p(ref, inc, 2000, seed) if small and len(cells) > 1 else stats.psi_p_value(row.psi, n, m, len(cells))
                ks_p, method = stats.ks_p_value(row.ks, n, m)
                out.append((row.axis, row.psi, row.ks, n, m, psi_p, ks_p, method))
            yield pd.DataFrame(out, columns=["axis", "psi", "ks", "n_ref", "n_inc", "psi_p", "ks_p", "ks_method"])

    tested = cut(found.join(low, "axis").mapInPandas(p_values, "axis string, psi double, ks double, n_ref long, n_inc long, psi_p double, ks_p double, ks_method string"))
    long = tested.select("axis", F.explode(F.array(F.struct(F.lit("psi").alias("test"), F.col("psi_p").alias("p")), F.struct(F.lit("ks").alias("test"), F.col("ks_p").alias("p")))).alias("t")).select("axis", F.concat("axis", F.lit(":"), "t.test").alias("name"), "t.p")
    q = adjust_bh(long).groupBy("axis").agg(F.min("q").alias("q"))
    return tested.join(q, "axis").withColumn("material", (F.col("q") <= alpha) & (F.col("ks") >= effect))


def draws_for(family: int, alpha: float) -> int:
    """Permutations that let a corrected p-value reach ``alpha``."""
    return max(2000, math.ceil(2 * family / alpha))


def as_axes(rows: DataFrame, axes: dict[str, Column], batch: Column) -> DataFrame:
    """Wide rows to axis, batch, value; null and NaN values are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("axis"), v.cast("double").alias("value")) for k, v in axes.items()))
    return rows.select(batch.cast("int").alias("batch"), F.explode(pairs).alias("x")).select("x.axis", "batch", "x.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
