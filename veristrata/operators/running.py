"""Running totals, ranks and distribution functions over any order, without one task that reads all rows.

Rows are dealt to ranges of their order, windows run inside ranges, and each
range hands on one short row for every group it holds. A window that orders
such rows has one row a range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.sources.session import cut

#: What may be carried from range to range: the aggregate, and how two of its values combine.
CARRIED = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


#: Rows of a table of groups that is sent to every task at most.
FEW = 10_000


def beside(groups: DataFrame) -> DataFrame:
    """A table of one row a group, stored, to be joined to the groups' rows: sent to every task while it has few rows, so that no task is dealt a whole group."""
    stored = cut(groups)
    return F.broadcast(stored) if stored.limit(FEW + 1).count() <= FEW else stored


def running(rows: DataFrame, order: Sequence[str], measures: Mapping[str, tuple[str, Column]], by: Sequence[str] = (), backward: bool = False) -> DataFrame:
    """``rows`` with each measure's running value, the row's own included, within ``by`` along ``order`` (or against it).

    ``measures`` maps a new column to one of ``CARRIED`` and its input. Nulls in
    an input don't count; a value is null until the first that isn't. ``order``
    must tell rows of a group apart (combine equal values first, or add an id):
    then a key that a third of all rows share is split over ranges. Nulls of
    ``order`` come first. The ranges are drawn by a sample of the keys and stored,
    so that a lost executor can't draw them anew.
    """
    by, order = list(by), list(order)
    inputs = {f"__in_{n}": c for n, (_, c) in measures.items()}
    dealt = rows.withColumns(inputs).repartitionByRange(*by, *order) if order or by else rows.withColumns(inputs)
    dealt = cut(dealt.withColumn("__range", F.spark_partition_id()))
    steps = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in order]
    inside = Window.partitionBy("__range", *by).orderBy(*steps).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = dealt.withColumns({f"__run_{n}": CARRIED[kind][0](f"__in_{n}").over(inside) for n, (kind, _) in measures.items()})
    totals = dealt.groupBy("__range", *by).agg(*(CARRIED[kind][0](f"__in_{n}").alias(f"__total_{n}") for n, (kind, _) in measures.items()))
    at = F.col("__range").desc() if backward else F.col("__range").asc()
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select("__range", *by, *(CARRIED[kind][0](f"__total_{n}").over(before).alias(f"__before_{n}") for n, (kind, _) in measures.items()))
    on = F.col("l.__range") == F.col("r.__range")
    for c in by:
        on = on & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    both = marked.alias("l").join(handed.alias("r"), on)

    def joined(n: str, kind: str) -> Column:
        here, carried = F.col(f"l.__run_{n}"), F.col(f"r.__before_{n}")
        return F.when(carried.isNull(), here).when(here.isNull(), carried).otherwise(CARRIED[kind][1](here, carried)).alias(n)

    return both.select(*(F.col(f"l.`{c}`") for c in rows.columns), *(joined(n, kind) for n, (kind, _) in measures.items()))


def value_ranks(rows: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Each different ``value`` of a group: ``n`` rows of it, ``below`` rows of smaller ones, ``total`` rows of the group, and ``average_rank``.

    Equal values are combined before anything is ordered. Nulls are left out. A
    row counts once, or as often as its ``weight`` says.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    run = running(each, [value], {"upto": ("sum", F.col("n"))}, by)
    whole = beside(each.groupBy(*by).agg(F.sum("n").alias("total"))) if by else None
    below = (F.col("upto") - F.col("n")).alias("below")
    average = (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("average_rank")
    if whole is None:
        total = each.agg(F.sum("n")).first()[0]
        return run.select(value, "n", below, F.lit(total).cast("long").alias("total"), average)
    on = None
    for c in by:
        same = F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
        on = same if on is None else on & same
    return run.alias("l").join(whole.alias("r"), on).select(*(F.col(f"l.`{c}`") for c in by), f"l.{value}", "n", below, "total", average)


def quantiles(rows: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``quantiles`` of each group, exact, by linear interpolation between ranks; nulls are left out, a group of nulls alone has no row.

    Values are combined and ranked in ranges; of each group the few that hold a
    wanted rank are kept. No task holds a group. A row counts once, or as often as
    its ``weight`` says.
    """
    by = list(by)
    ranked = value_ranks(rows.select(*by, F.col(value).cast("double").alias("__v"), *([weight] if weight else [])), "__v", by, weight)
    place = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    inside = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), inside(F.floor(place(q))).alias("lo"), inside(F.ceil(place(q))).alias("hi"), (place(q) - F.floor(place(q))).alias("part")) for i, q in enumerate(at)))
    held = ranked.select(*by, "__v", F.explode(F.filter(wanted, lambda w: w["lo"] | w["hi"])).alias("w"))
    ends = held.groupBy(*by, F.col("w.i").alias("i")).agg(F.max(F.when(F.col("w.lo"), F.col("__v"))).alias("lo"), F.max(F.when(F.col("w.hi"), F.col("__v"))).alias("hi"), F.first("w.part").alias("part"))
    point = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    got = ends.withColumn("x", F.struct("i", point.alias("v"))).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("quantiles"))
    return got.where(F.size("quantiles") == len(at))  # without groups, no rows are one row of nothing
