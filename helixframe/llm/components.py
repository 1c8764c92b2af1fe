"""Connected components of a link table by alternating large and small stars.

Every step is a minimum per node (pre-aggregated before its shuffle) and a join
of the links with those minima, whose hot keys the engine may split. No list of
neighbours is gathered, and nothing but a count reaches the driver. Each round is
written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove, shared_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over links ``a > b``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges`` (``a``, ``b``, any order): the least node it reaches.

    Links to itself and links with a null end are ignored; repeated links count once.
    """
    spark = edges.sparkSession
    ids = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNull().alias("x"), F.col("b").isNull().alias("y"))
    now = materialise(ids.filter("not x and not y and a <> b").select("a", "b").distinct())
    last = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or last == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        last = state
        path = shared_dir(spark)
        half = materialise(_star(now, True), path)
        now = materialise(_star(half, False))
        remove(spark, path)
