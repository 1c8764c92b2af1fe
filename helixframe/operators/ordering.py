"""Sorts, selections, dictionaries, histograms and ordered-row operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import positions


def sort_full(rows: DataFrame, key: str) -> DataFrame:
    """By the whole unsigned key, ascending."""
    return rows.orderBy(key)


def sort_half(rows: DataFrame, key: str, position: str, bits: int = 32) -> DataFrame:
    """By the low ``bits`` of the key; equal keys keep their order, given by ``position``."""
    return rows.orderBy(F.col(key).bitwiseAND((1 << bits) - 1), position)


def sort_partial(rows: DataFrame, key: str, position: str, first: int, last: int) -> DataFrame:
    """By bytes ``first`` to ``last`` (exclusive) of the key, lowest byte 0; stable."""
    part = F.shiftrightunsigned(F.col(key), 8 * first)
    width = 8 * (last - first)
    part = part.bitwiseAND((1 << width) - 1) if width < 63 else part
    return rows.orderBy(part, position)


def smallest(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The ``n`` first rows in an order, as a heap would give them up."""
    return rows.orderBy(*order).limit(n)


def first_match(rows: DataFrame, condition: Column, *order: Column | str) -> DataFrame:
    """The first element of a queue that satisfies a predicate."""
    return rows.filter(condition).orderBy(*order).limit(1)


def histogram(rows: DataFrame, value: Column, bins: int = 256) -> DataFrame:
    """``bin, n, start``: counts by the value modulo ``bins``, and the rows in lower bins.

    Counts are partial per task and merged; the running sum is over ``bins`` rows.
    """
    counts = rows.groupBy(F.pmod(value, F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def running_best(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Rows at which a running maximum rises: the first of equal values wins."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_best", F.max(value).over(w)).filter(F.col("_best").isNull() | (F.col(value) > F.col("_best"))).drop("_best")


def prefix_argmin(rows: DataFrame, group: list[str], order: str, delta: Column) -> DataFrame:
    """``group, at, least``: where the running sum of ``delta`` is least, first of ties."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("_sum", F.sum(delta).over(w))
    best = F.min(F.struct(F.col("_sum"), F.col(order))).alias("b")
    return sums.groupBy(*group).agg(best).select(*group, F.col(f"b.{order}").alias("at"), F.col("b._sum").alias("least"))


def offsets(rows: DataFrame, group: list[str], order: str, length: Column) -> DataFrame:
    """Rows with ``offset``: the sum of the lengths before each in its group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def linked(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rows with ``ordinal, prev, next`` and ``primary``: neighbours in their group and whether a row is its first."""
    w = Window.partitionBy(*group).orderBy(order)
    out = rows.withColumn("ordinal", F.row_number().over(w) - 1)
    return out.withColumn("prev", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w)).withColumn("primary", F.col("ordinal") == 0)


def numbered(rows: DataFrame, key: str, *ties: str) -> DataFrame:
    """Rows with ``n``, numbered from 0 in the order of ``key`` and ``ties``, without gathering them in one task.

    Ranges of (key, ties) part the rows, so a key that many rows share is spread as far as its ties differ.
    """
    return positions(rows.orderBy(key, *ties))


def distinct_scores(results: DataFrame, read: str = "read_id", score: str = "score", order: str = "ordinal") -> DataFrame:
    """The first results of each read in order of discovery, as many as it has different scores."""
    count = results.groupBy(read).agg(F.countDistinct(score).alias("_n"))
    w = Window.partitionBy(read).orderBy(order)
    return results.withColumn("_r", F.row_number().over(w)).join(count, read).filter("_r <= _n").drop("_r", "_n")
