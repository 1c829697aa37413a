"""Column functions: quantising, boxes, entropy, times, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(x: Column, scale: float, low: float | None = None, high: float | None = None) -> Column:
    """Fixed point by floor(x * scale + 0.5), clamped if bounds are given; null for what isn't finite."""
    if low is not None:
        x = F.greatest(x, F.lit(low))
    if high is not None:
        x = F.least(x, F.lit(high))
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.floor(x * scale + 0.5)).cast("long")


def entropy(p: Column) -> Column:
    """Base-2 entropy of an array of probabilities, each kept above 1e-12."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.greatest(x.cast("double"), F.lit(1e-12)) * F.log2(F.greatest(x.cast("double"), F.lit(1e-12))))


def softmax(x: Column) -> Column:
    """Of an array, its largest part subtracted first."""
    e = F.transform(x, lambda v: F.exp(v.cast("double") - F.array_max(x).cast("double")))
    return F.transform(F.array(e), lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))[0]


def top_mean(x: Column, k: int) -> Column:
    """Mean of the k largest parts."""
    best = F.slice(F.sort_array(x, asc=False), 1, k)
    return F.try_divide(F.aggregate(best, F.lit(0.0), lambda s, y: s + y), F.size(best))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def sentence_case(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))


def encoder_named(software: Column) -> Column:
    """Does a software tag name a batch tool?"""
    return F.lower(F.coalesce(software, F.lit(""))).rlike("pillow|imagemagick|ffmpeg|opencv|libjpeg|gd-jpeg")


def cache_key(content_sha256: Column, extractor: Column, version: Column) -> Column:
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(content_sha256.cast("binary"), zero, extractor.cast("binary"), zero, version.cast("binary"), zero), 256)


def dominant(pairs: Column) -> Column:
    """Most frequent part of an array; ties to the smallest."""
    each = F.transform(F.array_distinct(pairs), lambda v: F.struct((-F.size(F.filter(pairs, lambda x: x == v))).alias("neg"), v.alias("v")))
    return F.array_min(each)["v"]


def logistic_confidence(excess: Column, cap: float = 0.95) -> Column:
    """Confidence that grows with a score's excess over its threshold."""
    return F.least(F.lit(cap), F.greatest(F.lit(0.0), F.lit(0.5) + excess / 2))
