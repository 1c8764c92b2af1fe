"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path below :func:`base` that nothing uses yet."""
    return f"{base(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of :func:`base` and read from there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base(spark))
    return df.checkpoint()


def positions(rows: DataFrame) -> DataFrame:
    """Rows of a sorted frame with ``n``: their place in its order, from 0.

    Each task numbers its own rows, written down once, after the counts of the
    tasks before it (one row a task reaches the driver).
    """
    placed = checkpoint(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    first = placed.sparkSession.createDataFrame(starts, "_p long, _start long")
    return placed.join(F.broadcast(first), part == F.col("_p")).withColumn("n", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_start")
