"""Source, workers and drain as a streaming query, and one-item-a-worker parallel runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def drain(
    spark: SparkSession,
    path: str,
    schema: StructType,
    work: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    format: str = "parquet",
    files_per_batch: int = 16,
    name: str = "*.parquet",
) -> DataFrame:
    """Process all files below ``path`` once, a bounded number at a time, and return what was drained.

    ``files_per_batch`` is the back-pressure; the checkpoint lets a stopped run go
    on. Order of rows is not kept, as workers finish when they do.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).format(format).load(path)
    rows = work(source)
    query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def parallel(spark: SparkSession, items: Iterable[Any], worker: Callable[[Any], Any]) -> list[Any]:
    """``worker`` over items, one task each, results in order; a barrier for small driver-side work lists."""
    todo = list(items)
    return spark.sparkContext.parallelize(todo, max(1, len(todo))).map(worker).collect() if todo else []
