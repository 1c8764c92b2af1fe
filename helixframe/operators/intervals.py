"""Interval joins and nearest-key look-ups.

An inequality join alone would compare all pairs; here both sides are dealt to
bins of ``width`` and meet in an equi-join on the bin. A pair that shares several
bins is kept in one of them only, so results need no distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, hi) / width))


def _join(intervals: DataFrame, queries: DataFrame, width: int, keep: Column, meet: Column) -> DataFrame:
    """``intervals(lkey, rkey, ...)`` with ``queries(l, r, ...)``; ``meet`` is a point both cover, in whose bin the pair is kept."""
    a = intervals.withColumn("_bin", F.explode(_bins(F.col("lkey"), F.col("rkey"), width)))
    b = queries.withColumn("_bin", F.explode(_bins(F.col("l"), F.col("r"), width)))
    return a.join(b, "_bin").filter(keep & (F.col("_bin") == F.floor(meet / width))).drop("_bin")


def contained(intervals: DataFrame, queries: DataFrame, width: int = 64) -> DataFrame:
    """Intervals inside a query: ``l <= lkey < r`` and ``rkey < r``."""
    a = intervals.withColumn("_bin", F.floor(F.col("lkey") / width))
    b = queries.filter("l < r").withColumn("_bin", F.explode(_bins(F.col("l"), F.col("r"), width)))
    return a.join(b, "_bin").filter("lkey >= l and lkey < r and rkey < r").drop("_bin")


def containing(intervals: DataFrame, queries: DataFrame, width: int = 64) -> DataFrame:
    """Intervals that cover a query: ``lkey <= l`` and ``rkey >= r``."""
    a = intervals.withColumn("_bin", F.explode(_bins(F.col("lkey"), F.col("rkey"), width)))
    b = queries.withColumn("_bin", F.floor(F.col("l") / width))
    return a.join(b, "_bin").filter("lkey <= l and rkey >= r").drop("_bin")


def intersect(intervals: DataFrame, queries: DataFrame, width: int = 64) -> DataFrame:
    """Intervals that overlap a query: ``lkey < r`` and ``rkey > l``."""
    return _join(intervals, queries, width, F.expr("lkey < r and rkey > l"), F.greatest("lkey", "l"))


def nearest(keys: DataFrame, probes: DataFrame, group: list[str], left: bool = True, parts: int = 200) -> DataFrame:
    """``probes`` with ``found``: the equal or nearest lower (``left``) or higher key of the same group.

    Keys and probes of a group are merged in order and the last key seen is
    carried along. Quantiles of the key part every group, so a group that holds
    much of the data is worked on by many tasks; what a part needs from those
    before it is one key a group and part.
    """
    cols = probes.columns
    none = [F.lit(None).cast(t).alias(c) for c, t in probes.dtypes if c not in (*group, "key")]
    known = keys.select(*group, "key").distinct()
    cuts = known.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    sign = 1 if left else -1
    part = sign * F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("key"))) if cuts else F.lit(0)
    both = probes.select(*cols, F.lit(1).alias("_probe")).unionByName(known.select(*group, "key", *none, F.lit(0).alias("_probe"))).withColumn("_part", part)
    seen = F.when(F.col("_probe") == 0, F.col("key"))
    order = [F.col("key") if left else F.col("key").desc(), F.col("_probe")]  # equal keys come before their probes
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("found", F.last(seen, ignorenulls=True).over(inside)).filter("_probe = 1")
    last = both.groupBy(*group, "_part").agg((F.max(seen) if left else F.min(seen)).alias("_last"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(carried, same).select(*cols, F.coalesce("found", "_carried").alias("found"))


def in_order(found: DataFrame, query: list[str], insertion: str) -> DataFrame:
    """Intervals found for each query with ``seq``: their place by ``lkey``, equal ones in the order of insertion."""
    return found.withColumn("seq", F.row_number().over(Window.partitionBy(*query).orderBy("lkey", insertion)) - 1)


def exact(keys: DataFrame, probes: DataFrame, group: list[str]) -> DataFrame:
    """``probes`` joined with all keys equal to theirs."""
    return probes.join(keys, [*group, "key"])
