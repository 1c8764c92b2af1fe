"""Helpers shared by the document operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder (URI) below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session does not set it, a temporary folder is used in local mode
    (tests, a laptop); on a cluster that is an error. The folder is removed when
    the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/helixframe-{uuid.uuid4().hex}"
    if "://" not in path and not path.startswith("file:"):
        jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.FileSystem.get(conf).makeQualified(jvm.org.apache.hadoop.fs.Path(path)).toString()
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_dir`, on whatever file system it lies."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone (any other column is left out), null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


ROWS = 1024


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS`` rows at most, so few Python strings live at a time; unused Arrow memory goes back at the end."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)
    pa.default_memory_pool().release_unused()


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, pa.Array]]],
    schema: str,
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): doc_id and the columns that a kernel returns.

    ``make()`` runs once per task and returns the kernel, which gets the texts of
    one Arrow batch (64 MB of them at most) and returns columns by name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in slices(batches):
            cols = kernel(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **cols})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the kernel keeps; no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in slices(batches):
            yield batch.filter(pa.array(kernel(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def rewrite_texts(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], list[str | None]]]) -> DataFrame:
    """The rows of ``docs`` with their text rewritten by the kernel and all other columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in slices(batches):
            new = pa.array(kernel(batch.column(at).to_pylist()), batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo ``folds``; null ids hash as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
