"""Alignment sinks: SAM and GPA lines from a DataFrame of alignments.

An alignment row has ``read_ord, ordinal, path`` (an R/D string) and ``sections``,
an array of ``(aid, bid, apos, bpos, alen, blen, ppos)``; ``ref`` and ``query`` are
section tables ``(gid, name, len, seq)`` of both strands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nucleotide import cigar, cigar_reverse, revcomp

SAM_VERSION, GPA_VERSION = "1.0", "0.1"


def format_of(path: str, given: str | None = None) -> str:
    """``sam`` or ``gpa``, by name or by the path's ending; standard output takes GPA."""
    kind = given or ("gpa" if path.startswith("-") else path.rpartition(".")[2])
    if kind not in ("sam", "gpa"):
        raise ValueError(f"{kind} is no output format")
    return kind


def _sections(alignments: DataFrame, ref: DataFrame, query: DataFrame) -> DataFrame:
    """One row a section, with names, lengths and sequences of both sides and the section that follows."""
    rows = alignments.select("read_ord", "ordinal", "path", F.size("sections").alias("n"), F.posexplode("sections").alias("sec", "s"))
    after = Window.partitionBy("read_ord", "ordinal").orderBy("sec")
    rows = rows.select("read_ord", "ordinal", "path", "n", "sec", "s.*").withColumn("next_aid", F.lead("aid").over(after)).withColumn("next_apos", F.lead("apos").over(after))
    side = lambda t, p: t.select(F.col("gid").alias(f"{p}id"), F.col("name").alias(f"{p}name"), F.col("seq").alias(f"{p}seq"))
    names = ref.select(F.col("gid").alias("next_aid"), F.col("name").alias("next_name"))
    return rows.join(side(ref, "a"), "aid").join(side(query, "b"), "bid").join(names, "next_aid", "left")


def _piece() -> Column:
    """The section's part of the path."""
    return F.substring(F.col("path"), F.col("ppos") + 1, F.col("alen") + F.col("blen"))


def sam_header(ref: DataFrame, program: str | None = None, program_id: int = 0, command: str | None = None) -> DataFrame:
    """Header lines as ``ord, line``."""
    spark = ref.sparkSession
    first = spark.createDataFrame([(-1, f"@HD\tVN:{SAM_VERSION}\tSO:unsorted")], "ord long, line string")
    names = ref.filter("gid % 2 = 0").select((F.col("gid") / 2).cast("long").alias("ord"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), "len").alias("line"))
    last = [(1 << 40, "@RG\tID:1")]
    if program or command:
        text = "@PG" + (f"\tID:{program_id}\tPN:{program}" if program else "")
        last.append((1 + (1 << 40), text + (f"\tCL:{' '.join(command.split(chr(9)))}" if command else "")))
    return first.unionByName(names).unionByName(spark.createDataFrame(last, "ord long, line string")).orderBy("ord")


def sam_records(alignments: DataFrame, ref: DataFrame, query: DataFrame, clip: str = "S", secondary_flag: bool = True) -> DataFrame:
    """``read_ord, ordinal, sec, line``: a line a section.

    Sections on unlike strands are written reversed: flag 16, position from the
    other end, CIGAR and sequence reversed. The first alignment of a read clips
    soft; others by ``clip`` and, unless ``secondary_flag`` is off, with flag 256.
    """
    rows = _sections(alignments, ref, query)
    primary = F.col("ordinal") == 0
    back = F.col("aid").bitwiseAND(1) != F.col("bid").bitwiseAND(1)
    flag = F.when(back, 16).otherwise(0) + F.when(primary | F.lit(not secondary_flag), 0).otherwise(256)
    pos = F.when(back, F.length("aseq") - F.col("apos") - F.col("alen")).otherwise(F.col("apos")) + 1
    mark = F.when(primary, "S").otherwise(clip)
    head, tail = F.col("bpos"), F.length("bseq") - F.col("bpos") - F.col("blen")
    cut = lambda n: F.when(n > 0, F.concat(n.cast("string"), mark)).otherwise("")
    ops = F.when(back, F.concat(cut(tail), cigar_reverse(_piece()), cut(head))).otherwise(F.concat(cut(head), cigar(_piece()), cut(tail)))
    # a reversed record shows the reverse complement of the forward strand, and its places count on that strand
    text = F.when(back & (F.col("bid") % 2 == 1), revcomp(F.col("bseq"))).otherwise(F.col("bseq"))
    whole = F.when(mark == "S", text).otherwise(F.substring(text, F.col("bpos") + 1, F.col("blen")))
    seq = F.when(back, revcomp(whole)).otherwise(whole)
    line = F.concat_ws(
        "\t", "bname", flag, "aname", pos, F.lit(255), ops,
        F.coalesce("next_name", F.lit("*")), F.coalesce("next_apos", F.lit(0)), F.lit(0), seq, F.lit("*"), F.lit("RG:Z:1"),
    )
    return rows.select("read_ord", "ordinal", "sec", line.alias("line"))


def sam_unmapped(query: DataFrame) -> DataFrame:
    """A line for each forward section of unmapped reads."""
    line = F.concat_ws("\t", "name", F.lit("4\t*\t0\t0\t*\t*\t0\t0"), "seq", F.lit("*"), F.lit("RG:Z:1"))
    return query.filter("gid % 2 = 0").select(F.col("gid"), line.alias("line"))


def gpa_records(alignments: DataFrame, ref: DataFrame, query: DataFrame, prefix: str = "", compat: bool = False) -> DataFrame:
    """``read_ord, ordinal, sec, line``: sections named by a running number over all rows.

    The numbers follow (read_ord, ordinal, section): reads are counted first, so
    only one row a read is numbered in one place. Reverse positions count from
    the section's other end; ``compat`` takes a query section's length from the
    reference section of the same id, as some older files have it.
    """
    rows = _sections(alignments, ref, query)
    if compat:
        rows = rows.join(ref.select(F.col("gid").alias("bid"), F.col("len").alias("qlen")), "bid", "left")
    else:
        rows = rows.withColumn("qlen", F.length("bseq"))
    per_read = rows.groupBy("read_ord").agg(F.count("*").alias("n"))
    before = per_read.withColumn("base", F.sum("n").over(Window.orderBy("read_ord").rowsBetween(Window.unboundedPreceding, -1))).select("read_ord", F.coalesce("base", F.lit(0)).alias("base"))
    rows = rows.join(before, "read_ord")
    name = F.col("base") + F.row_number().over(Window.partitionBy("read_ord").orderBy("ordinal", "sec")) - 1
    rows = rows.withColumn("id", name)
    named = lambda n: F.concat(F.lit(prefix), n.cast("string"))
    sign = lambda c: F.when(F.col(c) % 2 == 0, "+").otherwise("-")
    at = lambda c, g, n: F.when(F.col(g) % 2 == 0, F.col(c)).otherwise(F.col(n) - F.col(c))
    line = F.concat_ws(
        "\t", F.lit("A"), named(F.col("id")), "aname", at("apos", "aid", "rlen"), "alen", sign("aid"),
        "bname", at("bpos", "bid", "qlen"), "blen", sign("bid"), cigar(_piece()),
        F.when(F.col("sec") == 0, "*").otherwise(named(F.col("id") - 1)),
        F.when(F.col("sec") == F.col("n") - 1, "*").otherwise(named(F.col("id") + 1)), F.lit("MQ:i:255"),
    )
    return rows.withColumn("rlen", F.length("aseq")).select("read_ord", "ordinal", "sec", line.alias("line"))


def gpa_header() -> str:
    return f"H\tVN:Z:{GPA_VERSION}"


def lines(header: DataFrame | list[str], records: DataFrame, unmapped: DataFrame | None = None) -> DataFrame:
    """All lines of a file in order, as ``line``."""
    spark = records.sparkSession
    if isinstance(header, list):
        header = spark.createDataFrame(list(enumerate(header)), "ord long, line string")
    parts = header.select(F.lit(0).alias("part"), F.col("ord").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), "line")
    parts = parts.unionByName(records.select(F.lit(1).alias("part"), F.col("read_ord").alias("a"), F.col("ordinal").alias("b"), F.col("sec").alias("c"), "line"))
    if unmapped is not None:
        parts = parts.unionByName(unmapped.select(F.lit(2).alias("part"), F.col("gid").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), "line"))
    return parts.orderBy("part", "a", "b", "c").select("line")


def write(rows: DataFrame, path: str) -> None:
    """Write lines as text files in order below ``path``, compressed where it ends in .gz or .bz2; ``-`` prints."""
    if path.startswith("-"):
        for r in rows.toLocalIterator():
            print(r["line"])
        return
    codec = {"gz": "gzip", "bz2": "bzip2"}.get(path.rpartition(".")[2], "none")
    rows.write.mode("overwrite").option("compression", codec).text(path)
