"""String graphs as DataFrames: sections of both strands, links, k-mers along paths, and the k-mer index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nucleotide import BASES, normal, revcomp, windows
from ..functions.storage import checkpoint
from .ordering import numbered


@dataclass(frozen=True)
class Graph:
    """``sections(gid, id, dir, name, len, seq)`` and ``edges(src, dst, ord)`` between gids.

    Even gids are forward strands, odd ones their reverse complements; an edge
    comes with its mirror. Frames never change, so a graph may be shared freely.
    """

    sections: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.sections.sparkSession

    def successors(self) -> DataFrame:
        """``gid, succ``: the adjacency list of every section, in the order links were given."""
        lists = self.edges.groupBy(F.col("src").alias("gid")).agg(F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("l"))
        rows = self.sections.select("gid").join(lists, "gid", "left")
        return rows.select("gid", F.coalesce(F.transform("l", lambda x: x["dst"]), F.array().cast("array<int>")).alias("succ"))

    def total_length(self) -> DataFrame:
        return self.sections.filter("dir = 0").agg(F.count("*").alias("sections"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))

    def persist(self) -> Graph:
        return Graph(self.sections.persist(), self.edges.persist())

    def disable(self) -> Graph:
        self.sections.unpersist()
        self.edges.unpersist()
        return self


def dictionary(rows: DataFrame, name: str, order: str, *ties: str) -> DataFrame:
    """``name, id``: dense ids from 0 in order of first appearance.

    ``order`` is a numeric column; names that first appear together go by ``ties``,
    then by name. Distinct names are numbered in parts, never in one task.
    """
    first = rows.groupBy(name).agg(F.min(F.struct(order, *ties)).alias("_first"))
    first = first.select(name, F.col(f"_first.{order}").alias("_at"), *[F.col(f"_first.{t}").alias(f"_tie{i}") for i, t in enumerate(ties)])
    return numbered(first, "_at", *[f"_tie{i}" for i in range(len(ties))], name).select(name, F.col("n").cast("int").alias("id"))


def build(segments: DataFrame, links: DataFrame | None = None, order: str | None = None) -> Graph:
    """A graph of segment and link records.

    Names get ids by first mention: ``order`` names a column of both tables that
    gives the order of records (segments before links where it is not given). A
    later segment of the same name replaces an earlier one; a segment that only a
    link names has length 0.
    """
    spark = segments.sparkSession
    if order is None:
        segments = segments.withColumn("_ord", F.monotonically_increasing_id())
        links = links.withColumn("_ord", F.lit(1 << 62) + F.monotonically_increasing_id()) if links is not None else None
        order = "_ord"
    seen = segments.select("name", F.col(order).alias("o"), F.lit(0).alias("i"))
    if links is not None:
        for i, c in enumerate(("src", "dst")):
            seen = seen.unionByName(links.select(F.col(c).alias("name"), F.col(order).alias("o"), F.lit(i).alias("i")))
    ids = dictionary(seen, "name", "o", "i")
    last = segments.groupBy("name").agg(F.max_by("seq", order).alias("seq"))
    fw = ids.join(last, "name", "left").select("id", "name", normal(F.coalesce("seq", F.lit(""))).alias("seq"))
    both = fw.select("id", F.lit(0).alias("dir"), "name", "seq").unionByName(fw.select("id", F.lit(1).alias("dir"), "name", revcomp(F.col("seq")).alias("seq")))
    sections = both.select((F.col("id") * 2 + F.col("dir")).alias("gid"), "id", "dir", "name", F.length("seq").alias("len"), "seq")
    if links is None:
        return Graph(sections, spark.createDataFrame([], "src int, dst int, ord long"))
    a, b = ids.select(F.col("name").alias("src"), F.col("id").alias("a")), ids.select(F.col("name").alias("dst"), F.col("id").alias("b"))
    ends = links.join(a, "src").join(b, "dst").select((F.col("a") * 2 + F.col("src_ori")).alias("src"), (F.col("b") * 2 + F.col("dst_ori")).alias("dst"), F.col(order).cast("long").alias("ord"))
    return Graph(sections, mirrored(ends))


def mirrored(links: DataFrame) -> DataFrame:
    """Links between gids with the mirror of each."""
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(1))
    return links.unionByName(links.select(flip("dst").alias("src"), flip("src").alias("dst"), "ord"))


CHUNK = 4096


def linear_kmers(rows: DataFrame, key: str, seq: str, k: int, tail: int = 0) -> DataFrame:
    """``key, pos, kmer`` for plain strings: every window of ``k`` letters A, C, G, T; with ``tail``, also ``after``, the letters that follow it.

    A string is cut into chunks first, so no array of places is longer than ``CHUNK``, whatever the string's length.
    Windows are cut from bytes (a letter beyond ASCII counts as N), at a cost that does not depend on their place.
    """
    text = rows.select(key, F.regexp_replace(seq, r"[^\x00-\x7f]", "N").cast("binary").alias("_text")).filter(F.length("_text") >= k)
    parts = text.select(key, "_text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("_text") - k, F.lit(0)), F.lit(CHUNK))).alias("_start"))
    part = F.substring("_text", F.col("_start") + 1, F.lit(CHUNK + k - 1 + tail))
    parts = parts.select(key, "_start", part.alias("_part")).withColumn("_plain", ~F.col("_part").cast("string").rlike("[^ACGT]"))
    last = F.least(F.length("_part") - k, F.lit(CHUNK - 1))
    found = parts.select(key, "_start", "_part", "_plain", F.explode(F.sequence(F.lit(0), last, F.lit(1))).alias("_at"))
    letters = lambda at, n: F.substring("_part", at + 1, F.lit(n)).cast("string")
    more = [letters(F.col("_at") + k, tail).alias("after")] if tail else []
    out = found.select(key, (F.col("_start") + F.col("_at")).alias("pos"), letters(F.col("_at"), k).alias("kmer"), *more, "_plain")
    return out.filter(F.col("_plain") | ~F.col("kmer").rlike("[^ACGT]")).drop("_plain")


def expand(kmers: DataFrame) -> DataFrame:
    """Windows with ambiguous letters as all k-mers they stand for; a window with N stands for none."""
    table = F.create_map(*[x for c, b in BASES.items() if b for x in (F.lit(c), F.array(*[F.lit(y) for y in b]))])
    clean = kmers.filter(~F.col("kmer").rlike("[^ACGTRYKMBVDHSW]"))
    plain = clean.filter(~F.col("kmer").rlike("[^ACGT]"))
    mixed = clean.filter(F.col("kmer").rlike("[^ACGT]"))
    none = F.array(F.lit(""))
    grown = F.aggregate(F.split("kmer", ""), none, lambda acc, c: F.when(c == "", acc).otherwise(F.flatten(F.transform(acc, lambda p: F.transform(F.element_at(table, c), lambda b: F.concat(p, b))))))
    return plain.unionByName(mixed.withColumn("kmer", F.explode(grown)))


def graph_kmers(graph: Graph, k: int, both_strands: bool = False) -> DataFrame:
    """``gid, pos, route, kmer``: every k-mer that starts in a section, along every path of links.

    ``route`` lists the gids passed after the first. Each step of the loop joins
    the open paths with the links once and is written down; ``k - 1`` steps
    suffice, as sections that are passed have one base at least (empty sections
    end a path), and the loop ends as soon as no path is open.
    """
    start = graph.sections.filter("len > 0")
    if not both_strands:
        start = start.filter("dir = 0")
    none = F.array().cast("array<int>")
    paths = start.select("gid", F.col("gid").alias("at"), F.col("len").alias("n"), F.col("seq").alias("s"), F.lit(0).alias("prev"), F.lit(k - 1).alias("need"), none.alias("route"))
    heads = graph.sections.filter("len > 0").select(F.col("gid").alias("dst"), F.substring("seq", 1, k - 1).alias("head"))
    steps = graph.edges.join(heads, "dst").select(F.col("src").alias("at"), "dst", "head")
    found = None
    for _ in range(k):
        # windows that start in the first section and end in what was added last
        own = paths.select("gid", "route", "n", "prev", F.posexplode(windows(F.col("s"), k)).alias("pos", "kmer"))
        own = own.filter((F.col("pos") < F.col("n")) & (F.col("pos") + k > F.col("prev"))).select("gid", "pos", "route", "kmer")
        found = own if found is None else found.unionByName(own)
        taken = F.expr("substring(head, 1, need)")
        paths = paths.filter("need > 0").join(steps, "at").select(
            "gid", F.col("dst").alias("at"), "n", F.concat("s", taken).alias("s"), F.length("s").alias("prev"),
            (F.col("need") - F.length(taken)).alias("need"), F.array_append("route", F.col("dst")).alias("route"),
        )
        paths = checkpoint(paths)
        if paths.isEmpty():
            break
    return expand(found)


def index(kmers: DataFrame) -> DataFrame:
    """``kmer, n, hits``: positions of each k-mer in order of (gid, pos).

    A table of hits by k-mer for look-ups; joins go by the plain k-mer rows, in
    which a repetitive k-mer is no single large value.
    """
    return kmers.groupBy("kmer").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("gid", "pos"))).alias("hits"))


def match(kmers: DataFrame, kmer: str) -> DataFrame:
    """Positions of one k-mer."""
    return kmers.filter(F.col("kmer") == kmer).select("gid", "pos").distinct().orderBy("gid", "pos")
