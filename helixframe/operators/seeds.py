"""Seeds: equal k-mers of queries and references, and the filters on them.

Reference k-mers come from both strands, query k-mers from the forward strand.
Filters run before any alignment, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nucleotide import revcomp
from ..functions.storage import checkpoint
from .graph import linear_kmers


def strands(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """``key, dir, seq``: each row and its reverse complement."""
    both = F.array(F.struct(F.lit(0).alias("dir"), F.col(seq).alias("s")), F.struct(F.lit(1).alias("dir"), revcomp(F.col(seq)).alias("s")))
    return rows.select(key, F.explode(both).alias("x")).select(key, F.col("x.dir").alias("dir"), F.col("x.s").alias("seq"))


def reference_kmers(rows: DataFrame, key: str, seq: str, k: int, tail: int = 0) -> DataFrame:
    """``rid, dir, rpos, kmer`` of both strands; with ``tail``, also ``a``, the letters that follow."""
    both = strands(rows, key, seq).withColumn("_id", F.struct(F.col(key).alias("rid"), "dir"))
    more = [F.col("after").alias("a")] if tail else []
    return linear_kmers(both, "_id", "seq", k, tail).select("_id.rid", "_id.dir", F.col("pos").alias("rpos"), "kmer", *more)


def query_kmers(rows: DataFrame, key: str, seq: str, k: int, tail: int = 0) -> DataFrame:
    """``qid, qpos, kmer`` of the forward strand; with ``tail``, also ``b``, the letters that follow."""
    more = [F.col("after").alias("b")] if tail else []
    return linear_kmers(rows, key, seq, k, tail).select(F.col(key).alias("qid"), F.col("pos").alias("qpos"), "kmer", *more)


def matched(ref: DataFrame, query: DataFrame) -> DataFrame:
    """Reference k-mers that some query has, written down, so that counting and joining them enumerates the reference once."""
    return checkpoint(ref.join(query.select("kmer").distinct(), "kmer", "left_semi"))


def counted_hits(ref: DataFrame, query: DataFrame) -> DataFrame:
    """``kmer, hits``: reference positions of each k-mer that some query has; the reference is reduced first."""
    wanted = query.select("kmer").distinct()
    return ref.join(wanted, "kmer", "left_semi").groupBy("kmer").agg(F.count("*").alias("hits"))


def seed_join(ref: DataFrame, query: DataFrame, repeat: int | None = None) -> DataFrame:
    """``qid, qpos, rid, dir, rpos`` (and ``a``, ``b`` where the sides have them): pairs of equal k-mers.

    The reference is reduced to what a query has first. With ``repeat``, k-mers with
    more reference positions than that are left out before the join, so no key of
    the join has more rows on that side.
    """
    ref = matched(ref, query)
    if repeat is not None:
        common = counted_hits(ref, query).filter(F.col("hits") <= repeat).select("kmer")
        query = query.join(common, "kmer")
    return query.join(ref, "kmer").select("qid", "qpos", "rid", "dir", "rpos", *[c for c in ("a", "b") if c in (*ref.columns, *query.columns)])


def repetitive(ref: DataFrame, query: DataFrame, repeat: int) -> DataFrame:
    """``kmer, hits, q_hits``: what the repeat filter leaves out, for inspection."""
    often = counted_hits(ref, query).filter(F.col("hits") > repeat)
    return often.join(query.groupBy("kmer").agg(F.count("*").alias("q_hits")), "kmer")


def drop_adjacent(seeds: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Seeds whose left neighbour on the diagonal was no seed of the query k-mer evaluated just before.

    ``evaluated`` has ``qid, qpos`` of the query k-mers that have hits; one with
    none, or with too many, between two of them resets the state.
    """
    order = Window.partitionBy("qid").orderBy("qpos")
    before = evaluated.select("qid", "qpos", F.lag("qpos").over(order).alias("prev")).filter("prev = qpos - 1")
    marked = seeds.join(before, ["qid", "qpos"], "left")
    left = seeds.select("qid", (F.col("qpos") + 1).alias("qpos"), "rid", "dir", (F.col("rpos") + 1).alias("rpos"))
    kept = marked.filter("prev is not null").drop("prev").join(left, ["qid", "qpos", "rid", "dir", "rpos"], "left_anti")
    return marked.filter("prev is null").drop("prev").unionByName(kept)


def chains(seeds: DataFrame, gap: int = 1) -> DataFrame:
    """Runs of seeds along a diagonal, no more than ``gap`` apart: ``qid, rid, dir, diagonal, start, end, n``."""
    rows = seeds.withColumn("diagonal", F.col("rpos") - F.col("qpos"))
    w = Window.partitionBy("qid", "rid", "dir", "diagonal").orderBy("qpos")
    fresh = (F.col("qpos") - F.lag("qpos").over(w) > gap) | F.lag("qpos").over(w).isNull()
    rows = rows.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w))
    out = rows.groupBy("qid", "rid", "dir", "diagonal", "run")
    return out.agg(F.min("qpos").alias("start"), F.max("qpos").alias("end"), F.count("*").alias("n")).drop("run")
