"""Command line: ``align``, ``bwa mem`` and the commands that only check their options.

    python -m helixframe align [options] REFERENCE [QUERY] -o OUT
    python -m helixframe bwa mem [options] REFERENCE QUERY

Without a query the reference is aligned to itself. Output is a folder of text
parts in order, or standard output for ``-``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.params import BWA, Params, parse_int
from .operators import graph, mapper, ordering
from .sources import readers, writers

# Options of the second program that have no counterpart here.
REFUSED = "mSPLUxpRHjhaCVYMI"


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe", description="Sequence graph alignment on Spark")
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("align", help="align a query to a reference")
    d = Params()
    for short, long, dest, default in (
        ("k", "seed-length", "k", d.k), ("r", "repcnt", "repeat", d.repeat), ("d", "depth", "depth", d.depth), ("f", "popcnt", "gapless", 0),
        ("a", "match", "m", d.m), ("b", "mismatch", "x", d.x), ("p", "gap-open", "gi", d.gi), ("q", "gap-extend", "ge", d.ge),
        ("x", "xdrop", "xdrop", 0), ("m", "min", "score", 0), ("t", "threads", "threads", 0), ("M", "memory", "memory", 0),
    ):
        a.add_argument(f"-{short}", f"--{long}", dest=dest, type=parse_int, default=default)
    a.add_argument("-c", "--clip", choices=("H", "S"), default=d.clip)
    a.add_argument("-o", "--out", default="-")
    a.add_argument("--rf", "--ref-format", dest="ref_format")
    a.add_argument("--qf", "--query-format", dest="query_format")
    a.add_argument("--of", "--output-format", dest="out_format")
    a.add_argument("--include-unmapped", dest="unmapped", action="store_true", default=True)
    a.add_argument("--omit-unmapped", dest="unmapped", action="store_false")
    a.add_argument("ref")
    a.add_argument("query", nargs="?")
    i = sub.add_parser("index", help="check options; an index is made with each run and not kept")
    i.add_argument("-k", "--seed-length", dest="k", type=parse_int, default=d.k)
    i.add_argument("ref")
    b = sub.add_parser("bwa", add_help=False, help="the mem command with its own defaults, SAM to standard output")
    b.add_argument("mode", choices=("mem", "index"))
    for short, dest, default in (("k", "k", BWA.k), ("c", "repeat", BWA.repeat), ("A", "m", BWA.m), ("B", "x", BWA.x), ("O", "gi", BWA.gi), ("E", "ge", BWA.ge), ("d", "xdrop", BWA.xdrop), ("T", "score", BWA.score), ("t", "threads", 1), ("v", "verbose", 3)):
        b.add_argument(f"-{short}", dest=dest, type=parse_int, default=default)
    for c in REFUSED:
        b.add_argument(f"-{c}", dest=f"refused_{c}", action="store_true", help=argparse.SUPPRESS)
    b.add_argument("ref")
    b.add_argument("query", nargs="?")
    return top


def summary(o: argparse.Namespace) -> str:
    """The options in one line."""
    return f"helixframe align -t{o.threads} -k{o.k} -r{o.repeat} -d{o.depth} -f{o.gapless} -a{o.m} -b{o.x} -p{o.gi} -q{o.ge} -x{o.xdrop} -m{o.score} -c{o.clip}"


def load_graph(spark: SparkSession, path: str, format: str | None) -> tuple[graph.Graph, bool]:
    """A source as a graph, and whether it is one (GFA) or plain sequences."""
    segments, links = readers.read_records(spark, path, format)
    is_graph = readers.detect(spark, path, format) == "gfa"
    return graph.build(segments, readers.joinable(links) if is_graph else None).persist(), is_graph


def run(spark: SparkSession, ref: str, query: str | None, p: Params, out_format: str, ref_format: str | None = None, query_format: str | None = None, unmapped: bool = True, command: str | None = None) -> DataFrame:
    """All lines of the output, in order."""
    target, _ = load_graph(spark, ref, ref_format)
    source, is_graph = load_graph(spark, query or ref, query_format if query else ref_format)
    sections = source.sections
    if is_graph:
        found = mapper.align_graph(target, source, p)
        missing = sections if found.isEmpty() else sections.limit(0)
    else:
        reads = sections.filter("dir = 0").select(F.col("id").cast("long").alias("read_ord"), "seq")
        found = mapper.align(target, reads, p)
        # sections of a read are numbered 0 and 1 by the mapper
        own = F.transform("sections", lambda s: s.withField("bid", (F.col("read_ord") * 2).cast("int") + s["bid"]))
        found = found.withColumn("sections", own).persist()
        missing = sections.join(found.select(F.col("read_ord").alias("id")).distinct(), "id", "left_anti")
    found = ordering.distinct_scores(found, "read_ord")
    if out_format == "sam":
        head = writers.sam_header(target.sections, command=command)
        return writers.lines(head, writers.sam_records(found, target.sections, sections, p.clip), writers.sam_unmapped(missing) if unmapped else None)
    return writers.lines([writers.gpa_header()], writers.gpa_records(found, target.sections, sections))


def main(argv: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if args and args[0] not in ("align", "index", "bwa", "-h", "--help"):
        args.insert(0, "align")  # bare options mean align
    o = _parser().parse_args(args)
    if o.command == "index" or o.command == "bwa" and o.mode == "index":
        print("an index is made with each run and not kept", file=sys.stderr)
        return 1
    if o.command == "bwa":
        refused = [c for c in REFUSED if getattr(o, f"refused_{c}")]
        if refused or not o.query:
            print(f"not supported: -{', -'.join(refused)}" if refused else "bwa mem needs a query", file=sys.stderr)
            return 1
        p = Params(k=o.k, repeat=o.repeat, m=o.m, x=o.x, gi=o.gi, ge=o.ge, xdrop=o.xdrop, score=o.score, clip="S")
        out, out_format, o.ref_format, o.query_format, o.unmapped = "-", "sam", None, None, True
    else:
        p = Params(k=o.k, repeat=o.repeat, depth=o.depth, m=o.m, x=o.x, gi=o.gi, ge=o.ge, xdrop=o.xdrop, gapless=o.gapless, score=o.score, clip=o.clip)
        out, out_format = o.out, writers.format_of(o.out, o.out_format)
        print(summary(o), file=sys.stderr)
        if o.depth != Params().depth:
            print("note: --depth has no effect", file=sys.stderr)
    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    lines = run(spark, o.ref, o.query, p, out_format, o.ref_format, o.query_format, o.unmapped, "helixframe " + " ".join(args))
    writers.write(lines, out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
