"""Sequence and graph sources: FASTA, FASTQ and GFA as DataFrames.

``read_records`` gives ``segments(name, comment, seq, qual)`` and, for GFA,
``links(src, src_ori, dst, dst_ori, cigar)``. Paths may be local or in any store
Spark reads; ``.gz`` and ``.bz2`` are decoded by Spark. ``http://`` and ``ftp://``
sources are fetched to the driver and must fit there; ``-`` is standard input.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nucleotide import version

# Fixed: file name endings by format, and codecs by ending.
ENDINGS = {
    "fasta": ("fasta", "fas", "seq", "fna", "ffn", "fa"),
    "fastq": ("fastq", "fq"),
    "fast5": ("fast5", "f5"),
    "gfa": ("gfa",),
}
CODECS = ("gz", "bz2")
REFUSED_CODECS = ("lz", "lzma", "xz", "z")
NAMES = {"fasta": "fasta", "fa": "fasta", "fastq": "fastq", "fq": "fastq", "fast5": "fast5", "f5": "fast5", "gfa": "gfa"}
SEGMENTS = "name string, comment string, seq string, qual string"
LINKS = "src string, src_ori int, dst string, dst_ori int, cigar string"


def strip_codec(path: str) -> str:
    """The path without its codec's ending; a codec that is known but not supported is an error."""
    stem, _, end = path.rpartition(".")
    if stem and end in REFUSED_CODECS:
        raise ValueError(f"{path}: .{end} files are not supported")
    return stem if stem and end in CODECS else path


def detect_by_name(path: str) -> str | None:
    end = strip_codec(path).rpartition(".")[2].lower()
    return next((f for f, ends in ENDINGS.items() if end in ends), None)


def detect_by_content(head: str) -> str | None:
    """Format by the markers in the first 32 characters; the last marker found decides."""
    found = None
    head = head[:32]
    for i, c in enumerate(head):
        if c == ">":
            found = "fasta"
        elif c == "@":
            found = "fastq"
        elif c == "H" and head[i + 1 : i + 2] == "\t":
            found = "gfa"
    return found


def detect(spark: SparkSession, path: str, given: str | None = None) -> str:
    """Format of a source: as given, by its name, or by its content."""
    if given:
        if given not in NAMES:
            raise ValueError(f"{given} is no input format")
        found = NAMES[given]
    else:
        found = detect_by_name(path)
        if found is None:
            # 32 lines have the first 32 characters
            first = lines_of(spark, path).limit(32).select(F.substring("value", 1, 33).alias("value")).collect()
            found = detect_by_content("\n".join(r["value"] for r in first) + "\n") if first else None
    if found is None:
        raise ValueError(f"{path}: no known format")
    if found == "fast5":
        raise ValueError("FAST5 files are not supported")
    return found


def lines_of(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Lines (or parts between ``sep``) of a source, as ``value``."""
    if path.startswith("<"):
        raise ValueError("sources that run a command are not supported")
    if path == "-" or re.match(r"(http|ftp)://", path):
        text = sys.stdin.read() if path == "-" else urlopen(path).read().decode()  # noqa: S310
        parts = text.split(sep) if sep else text.splitlines()
        return spark.createDataFrame([(p,) for p in parts], "value string")
    strip_codec(path)
    reader = spark.read
    return (reader.option("lineSep", sep) if sep else reader).text(path)


def fasta_parts(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA source in parts, as ``value``, each from the text after a ``>`` that begins a line to the next such line.

    The first ``>`` of a file is taken off; a file should begin with one, or with blank lines. (A header of the first
    block of a file that itself begins with ``>`` loses that mark.)
    """
    if path == "-" or re.match(r"(http|ftp)://", path):
        return lines_of(spark, path, "\n>").withColumn("value", F.regexp_replace("value", "^>", ""))
    strip_codec(path)
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_block_start").alias("at"))
    return rows.select(F.when(F.col("at") == 0, F.regexp_replace("value", "^>", "")).otherwise(F.col("value")).alias("value"))


def fasta(parts: DataFrame) -> DataFrame:
    """``segments`` from :func:`fasta_parts`.

    A header runs to its line's end, whatever marks it holds; a ``>`` in a sequence
    begins the next record. A name ends at the first blank; the rest of its line is
    the comment. The sequence is all further printable characters.
    """
    record = r"(?s)(?:^|>)([^\n]*(?:\n[^>]*)?)"
    lines = parts.select(F.explode(F.regexp_extract_all("value", F.lit(record), F.lit(1))).alias("value"))
    v = F.col("value")
    head = F.regexp_replace(F.regexp_extract(v, r"^([^\n]*)", 1), r"^[ \t]+|[ \t\r]+$", "")
    name = F.regexp_replace(F.regexp_extract(head, r"^([^ ]*)", 1), r"[ \t]+$", "")
    comment = F.regexp_replace(F.regexp_extract(head, r"^[^ ]* (.*)$", 1), r"^[ \t]+|[ \t]+$", "")
    body = F.regexp_extract(v, r"(?s)^[^\n]*\n(.*)$", 1)
    seq = F.regexp_replace(body, r"[^\x21-\x7e]", "")
    parts = lines.filter(F.length(F.regexp_replace(v, r"\s", "")) > 0)
    return parts.select(name.alias("name"), comment.alias("comment"), seq.alias("seq"), F.lit("").alias("qual"))


def parse_fastq(text: str) -> Iterator[tuple[str, str, str, str]]:
    """Records of a FASTQ text; sequences may take several lines and qualities may hold any mark.

    A record whose quality is short ends the stream.
    """
    at, size = text.find("@"), len(text)
    while 0 <= at < size:
        end = text.find("\n", at)
        if end < 0:
            return
        head = text[at + 1 : end].strip(" \t\r")
        name, _, comment = head.partition(" ")
        plus = text.find("+", end)
        if plus < 0:
            return
        seq = re.sub(r"[^\x21-\x7e]", "", text[end:plus])
        at = text.find("\n", plus)
        at = size if at < 0 else at + 1
        qual = []
        while at < size and len(qual) < len(seq):
            if text[at] > " ":
                qual.append(text[at])
            at += 1
        if len(qual) < len(seq):
            return
        yield name.strip(" \t"), comment.strip(" \t"), seq, "".join(qual)
        at = text.find("@", at)


def fastq(spark: SparkSession, path: str, skip_qual: bool = False) -> DataFrame:
    """``segments`` of FASTQ files, one task a file, as records cannot be told apart from the middle."""
    if path == "-" or re.match(r"(http|ftp)://", path):
        text = "\n".join(r["value"] for r in lines_of(spark, path).collect())
        files = spark.createDataFrame([(text,)], "value string")
    else:
        strip_codec(path)
        files = spark.read.text(path, wholetext=True)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                rows = list(parse_fastq(text))
                if rows:
                    yield pd.DataFrame(rows, columns=["name", "comment", "seq", "qual"])

    out = files.mapInPandas(parse, SEGMENTS)
    return out.withColumn("qual", F.lit("")) if skip_qual else out


def gfa(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``segments`` and ``links`` of GFA lines; the header must give version 1.0.0 or later.

    Containments and paths are skipped; a record of any other type is an error.
    """
    v = F.col("value")
    lines = lines.withColumn("value", F.regexp_replace(v, r"\r$", "")).filter(F.length("value") > 0)
    state = lines.agg(
        F.max(F.when(v.startswith("H\t"), version(v))).alias("version"),
        F.max(F.when(~v.rlike(r"^[HSLCP#](\t|$)") & ~v.startswith("#"), v)).alias("odd"),
    ).first()
    if state["version"] is None or state["version"] < 0x10000:
        raise ValueError("a GFA source needs a header of version 1.0 or later")
    if state["odd"] is not None:
        raise ValueError(f"unknown GFA record: {state['odd'][:40]}")
    f = F.split(v, "\t")
    segments = lines.filter(v.startswith("S\t")).select(f[1].alias("name"), F.lit("").alias("comment"), f[2].alias("seq"), F.lit("").alias("qual"))
    ori = lambda c: F.when(c == "+", 0).otherwise(1).cast("int")
    field = F.coalesce(F.get(f, F.lit(5)), F.lit("*"))
    links = lines.filter(v.startswith("L\t")).select(
        f[1].alias("src"), ori(f[2]).alias("src_ori"), f[3].alias("dst"), ori(f[4]).alias("dst_ori"), F.when(field == "*", "").otherwise(field).alias("cigar")
    )
    return segments, links


def read_records(spark: SparkSession, path: str, format: str | None = None, skip_qual: bool = False) -> tuple[DataFrame, DataFrame]:
    """``segments`` and ``links`` of a source of any supported format."""
    kind = detect(spark, path, format)
    none = spark.createDataFrame([], LINKS)
    if kind == "fasta":
        return fasta(fasta_parts(spark, path)), none
    if kind == "fastq":
        return fastq(spark, path, skip_qual), none
    return gfa(lines_of(spark, path))


def joinable(links: DataFrame) -> DataFrame:
    """Links without an overlap, the only ones a graph takes."""
    return links.filter(F.col("cigar").startswith("0"))
