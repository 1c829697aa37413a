"""Small operators over ledgers, scans, checks and samples: filters, set comparisons, rankings, seeded samples.

Ranks and cumulative shares meet as counts of distinct values, not as rows, so a
group with a third of all rows sends one row for each of its values.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.operators.running import value_ranks


def read_ledger(ledger: DataFrame, types: Iterable[str] = (), since: int | None = None) -> DataFrame:
    """Records of some types, after a sequence number."""
    if types := tuple(types):
        ledger = ledger.where(F.col("type").isin(*types))
    return ledger if since is None else ledger.where(F.col("seq") > since)


def excluded_by(capabilities: list[str], tier: int, model: bool) -> Column:
    """Why a check isn't run, or null: disabled, a capability that is missing, no model, or a higher tier, in this order. Columns: disabled, requires, needs_model, tier."""
    lacks = F.size(F.array_except("requires", F.array(*map(F.lit, capabilities)))) > 0
    return F.when(F.col("disabled"), "disabled").when(lacks, "capability").when(F.col("needs_model") & F.lit(not model), "no_model").when(F.col("tier") > tier, "tier")


def estimated_seconds(images: Column, measured: Column, rate: float = 16.84) -> Column:
    """Cost of a check at so many images a second; null where it isn't estimated."""
    return F.when(measured, F.round(images / rate, 1))


def scans_changed(known: DataFrame, present: DataFrame) -> DataFrame:
    """``scan_id`` and ``change``: ``deleted`` (known only) or ``new`` (present only)."""
    gone = known.select("scan_id").distinct().join(present, "scan_id", "left_anti").withColumn("change", F.lit("deleted"))
    return gone.unionByName(present.select("scan_id").distinct().join(known, "scan_id", "left_anti").withColumn("change", F.lit("new")))


def with_taxonomy(findings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Module and kind of each finding's attack class; ``unknown`` where the taxonomy has none."""
    return findings.join(taxonomy, "attack_class", "left").fillna("unknown", ["module", "kind"])


def input_state(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """Each record's input: ``missing``, ``swapped`` (its bytes have another hash) or ``same``. ``records``: ref, sha256; ``inputs``: ref, content."""
    found = records.join(inputs.select("ref", F.sha2(F.col("content").cast("binary"), 256).alias("__now"), F.lit(True).alias("__there")), "ref", "left")
    return found.withColumn("state", F.when(F.col("__there").isNull(), "missing").when(F.col("__now").eqNullSafe(F.col("sha256")), "same").otherwise("swapped")).drop("__now", "__there")


def payload_state(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Is the payload of each record's hash there? ``records``: seq, payload_sha256; ``payloads``: sha256."""
    held = payloads.select(F.col("sha256").alias("payload_sha256"), F.lit(True).alias("__there")).distinct()
    return records.join(held, "payload_sha256", "left").withColumn("state", F.when(F.col("payload_sha256").isNull(), "none").when(F.col("__there"), "held").otherwise("missing")).drop("__there")


def gaps(rows: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    """Seconds since the row before, by group; null for the first."""
    before = F.lag(time).over(Window.partitionBy(by).orderBy(time, tie))
    seconds = lambda x: F.unix_micros(x.cast("timestamp"))
    return rows.withColumn("gap", F.round((seconds(F.col(time)) - seconds(before)) / 1e6, 3))


def shares(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Each distinct value's share of rows at or below it (``ecdf``) and average rank (``mean_rank``, from 1; ties share theirs)."""
    ranked = value_ranks(rows, value, [by])
    return ranked.select(by, value, "n", ((F.col("below") + F.col("n")) / F.col("total")).alias("ecdf"), F.col("average_rank").alias("mean_rank"))


#: Ids of a bucket, as a power of two, and how many levels of buckets an id of 63 bits needs.
BUCKET_BITS, BUCKET_LEVELS = 12, 4


def ordered_digest(rows: DataFrame, by: str, key: str, text: Column, name: str = "digest") -> DataFrame:
    """One digest of each group's texts in the order of a whole-number ``key``: of buckets of ids first, then of buckets' digests.

    A task holds the texts of one bucket. The same ids in the same buckets give
    the same digest, whatever else the table holds. Keys that aren't unique are
    ordered by their texts.
    """
    level = rows.select(by, F.col(key).alias("__k"), text.alias("__t"))
    for _ in range(BUCKET_LEVELS):
        up = F.shiftright("__k", BUCKET_BITS).alias("__up")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__t"))), lambda x: x["__t"]), "|")
        level = level.groupBy(by, up).agg(F.sha2(joined.cast("binary"), 256).alias("__t")).withColumnRenamed("__up", "__k")
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__t"))), lambda x: x["__t"]), "|")
    return level.groupBy(by).agg(F.sha2(top.cast("binary"), 256).alias(name))


def top_by(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``place``; Spark limits groups before the shuffle too."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def majority(rows: DataFrame, by: str, value: str) -> DataFrame:
    """A group's most frequent value (ties to the smaller) and whether it beats all others: ``value``, ``n``, ``strict``."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"), F.max("n").alias("top"))
    tied = counts.join(best, by).groupBy(by).agg(F.count_if(F.col("n") == F.col("top")).alias("at_top"), F.first("b").alias("b"))
    return tied.select(by, F.col("b.v").alias("value"), (-F.col("b.m")).alias("n"), (F.col("at_top") == 1).alias("strict"))


def last_of(ledger: DataFrame, by: str, kind: str) -> DataFrame:
    """Each group's last record of a type: ``seq`` and ``rec``."""
    return ledger.where(F.col("type") == kind).groupBy(by).agg(F.max("seq").alias("seq"), F.max_by("rec", "seq").alias("rec"))


def cadence(ledger: DataFrame, every: int, kind: str) -> DataFrame:
    """Sequence numbers where a record of a type is due, once in ``every``, but another stands."""
    return ledger.where((F.pmod("seq", F.lit(every)) == every - 1) & (F.col("type") != kind)).select("seq", "type")


def seeded_sample(rows: DataFrame, key: str, seed: str, n: int, always: Column) -> DataFrame:
    """``n`` rows without replacement: those that ``always`` marks first, then by a hash of key and seed."""
    return rows.orderBy(always.desc(), F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)).cast("binary")), key).limit(n)


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object of string and integer columns with its keys in order; nulls are written."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def unknown_ids(known: DataFrame, given: DataFrame, name: str) -> DataFrame:
    """Ids that are given but not known."""
    return given.select(name).distinct().join(known.select(name), name, "left_anti")


def compared(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Every value of two columns, and where it stands: ``left``, ``right`` or ``both``."""
    sides = left.select(F.col(name), F.lit(1).alias("side")).unionByName(right.select(F.col(name), F.lit(2).alias("side"))).distinct()
    where = F.sum("side")
    return sides.groupBy(name).agg(F.when(where == 1, "left").when(where == 2, "right").otherwise("both").alias("stands"))


def clean_value(raw: Column, most: int = 128) -> Column:
    """Supplied text that is safe to show: control, format, unassigned and private characters and separators become ``_``; trimmed and capped."""
    return F.left(F.trim(F.regexp_replace(raw, r"[\p{Cc}\p{Cf}\p{Cn}\p{Co}\p{Zl}\p{Zp}]", "_")), F.lit(most))


def duplicate_confidence(members: Column, cosine: Column, least: float) -> Column:
    """Confidence in a copies cluster: by its mean cosine over the threshold, or by its size alone where cosines are missing."""
    size = F.least(members, F.lit(10)) * 0.02
    return F.when(cosine.isNotNull(), F.least(F.lit(0.95), 0.5 + 0.45 * (cosine - least) / max(1e-6, 1 - least) + size)).otherwise(F.least(F.lit(0.5), 0.3 + 0.02 * members))
