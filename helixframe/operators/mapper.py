"""Alignment of reads to a sequence graph: seeds, extension both ways, and upkeep of results.

All seeds of a read are worked on in order of query position, as each result
changes which later seeds are new. Reads are independent: one group a read, so
the work spreads over reads. Reference paths are followed from section to section
as far as an extension can reach.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import Params
from ..functions.storage import checkpoint
from . import screen
from .align import Fill, Front, gapless_count, join_fronts, reach, reverse_path
from .graph import Graph, graph_kmers
from .seeds import counted_hits, drop_adjacent, matched, query_kmers

MOST_PATHS = 256
MOST_SECTIONS = 4096
WIDTH = screen.WIDTH

Section = tuple[int, int, int, int, int, int, int]
"""aid, bid, apos, bpos, alen, blen, ppos."""

ALIGNMENT = "read_ord long, ordinal int, score long, path string, sections array<struct<aid:int,bid:int,apos:int,bpos:int,alen:int,blen:int,ppos:int>>"


@dataclass
class Sequences:
    """A graph held by a worker: text of each gid and its successors."""

    seq: dict[int, str]
    succ: dict[int, list[int]]

    def paths(self, gid: int, pos: int, reach: int) -> list[tuple[list[tuple[int, int, int]], str]]:
        """Paths of ``reach`` letters (or to their end) from a place: parts ``(gid, start, length)`` and their text.

        Best-first in length; more than ``MOST_PATHS`` at once raise an error rather than go missing.
        """
        done, todo = [], [([], "", gid, pos)]
        while todo:
            parts, text, g, at = todo.pop(0)
            own = self.seq[g][at : at + reach - len(text)]
            parts, text = [*parts, (g, at, len(own))], text + own
            more = self.succ.get(g, []) if len(text) < reach else []
            if not more:
                done.append((parts, text))
            todo += [(parts, text, s, 0) for s in more]
            if len(done) + len(todo) > MOST_PATHS:
                raise ValueError(f"more than {MOST_PATHS} paths within reach of section {gid}")
        return done


@dataclass
class Result:
    score: int
    path: str
    sections: list[Section]
    #: (place on the query, rgid, rpos, section) along the alignment, for the band test
    track: list[tuple[int, int, int, int]] = field(default_factory=list)

    @cached_property
    def by_place(self) -> dict[int, list[tuple[int, int, int]]]:
        out: dict[int, list[tuple[int, int, int]]] = {}
        for q, g, r, section in self.track:
            out.setdefault(q, []).append((g, r, section))
        return out


def cut_sections(path: str, a: list[tuple[int, int, int]], b: list[tuple[int, int, int]]) -> list[Section]:
    """Sections of a path over parts ``(gid, start, length)`` of both sides: cut wherever a side enters a new part."""
    out: list[Section] = []
    ai = bi = 0
    ap, bp = (a[0][1] if a else 0), (b[0][1] if b else 0)
    begin = (ap, bp, 0)

    def close(end: int) -> None:
        if ap > begin[0] or bp > begin[1]:
            out.append((a[ai][0], b[bi][0], begin[0], begin[1], ap - begin[0], bp - begin[1], begin[2]))

    k = 0
    while k < len(path):
        step = 2 if path[k : k + 2] == "DR" else 1
        on_a, on_b = step == 2 or path[k] == "R", step == 2 or path[k] == "D"
        full_a = on_a and ap == a[ai][1] + a[ai][2]
        full_b = on_b and bp == b[bi][1] + b[bi][2]
        if full_a or full_b:
            close(k)
            if full_a:
                ai += 1
                ap = a[ai][1]
            if full_b:
                bi += 1
                bp = b[bi][1]
            begin = (ap, bp, k)
        ap, bp, k = ap + on_a, bp + on_b, k + step
    close(k)
    return out


def _flip(parts: list[tuple[int, int, int]], seq: dict[int, str]) -> list[tuple[int, int, int]]:
    """Parts of a path on the other strand."""
    return [(g ^ 1, len(seq[g]) - at - n, n) for g, at, n in reversed(parts)]


def _fill_paths(ref: Sequences, rg: int, rp: int, btext: str, p: Params) -> Fill:
    """``btext`` filled along all reference paths from a place; none along a path whose first window fails the gapless filter.

    Sections are taken in order of the letters before them. Paths that wait before the same section go on as one, so a
    row of bubbles costs as much as its sections, not as its paths.
    """
    most = reach(len(btext), p)
    if p.ge == 0 or p.xdrop < 0:  # a cycle could be followed for ever; between two letters of b one round is enough
        most = min(most, (len(btext) + 1) * (sum(map(len, ref.seq.values())) + 1))
    fill = Fill(btext, p)
    waiting: dict[tuple[int, int], Front] = {}
    order: list[tuple[int, int, int]] = []

    def wait(g: int, at: int, front: Front) -> None:
        held = waiting.get((g, at))
        waiting[g, at] = join_fronts(held, front) if held else front
        heappush(order, (front.at, g, at))

    begun: dict[tuple, Front | None] = {(): fill.root()}
    for parts, text in ref.paths(rg, rp, WIDTH + 1):
        if min(len(text), len(btext)) >= WIDTH and gapless_count(text, btext, WIDTH) <= p.gapless:
            continue
        for i, (g, at, n) in enumerate(parts[:-1]):
            before, key = begun[tuple(parts[:i])], tuple(parts[: i + 1])
            if key not in begun:
                begun[key] = before and fill.grow(before, ref.seq[g][at : at + n], (g, at))
        front = begun[tuple(parts[:-1])]
        if front:
            wait(*parts[-1][:2], front)
    while order:
        _, g, at = heappop(order)
        front = waiting.pop((g, at), None)
        if front is None:
            continue  # went on with another
        if len(fill.stretches) >= MOST_SECTIONS:
            raise ValueError(f"an extension from section {rg} passes more than {MOST_SECTIONS} sections")
        front = fill.grow(front, ref.seq[g][at : at + most - front.at], (g, at))
        if front and front.at < most:
            for s in ref.succ.get(g, []):
                wait(s, 0, front)
    return fill


def _best(ref: Sequences, query: Sequences, rg: int, rp: int, qg: int, qp: int, p: Params):
    """Best extension over all paths from a place on both sides: score, path, and the parts it takes of either."""
    found = None
    for bparts, btext in query.paths(qg, qp, 1 << 30):
        fill = _fill_paths(ref, rg, rp, btext, p)
        if found is None or fill.score > found[0].score:
            found = fill, bparts
    fill, bparts = found
    path, passed, blen = fill.trace()
    return fill.score, path, [(g, at, n) for (g, at), n in passed], _trim(bparts, blen)


def _trim(parts: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    out = []
    for g, at, size in parts:
        if n <= 0:
            break
        out.append((g, at, min(size, n)))
        n -= size
    return out


def _seed_parts(side: Sequences, gid: int, pos: int, route: list[int] | None, k: int) -> list[tuple[int, int, int]]:
    out = []
    for n, g in enumerate([gid, *(route or [])]):
        at = pos if n == 0 else 0
        size = min(k, len(side.seq[g]) - at)
        out.append((g, at, size))
        k -= size
    return out


def extend_seed(ref: Sequences, query: Sequences, rg: int, rp: int, qg: int, qp: int, p: Params, route: list[int] | None = None, qroute: list[int] | None = None) -> Result | None:
    """The alignment through a seed of ``k`` matches at (rg, rp) and (qg, qp), or None below the threshold.

    The threshold holds for the two extensions without the seed; the score has it.
    """
    seed_a, seed_b = _seed_parts(ref, rg, rp, route, p.k), _seed_parts(query, qg, qp, qroute, p.k)
    (g, at, size), (h, bt, bsize) = seed_a[-1], seed_b[-1]
    fw = _best(ref, query, g, at + size, h, bt + bsize, p)
    rv = _best(ref, query, rg ^ 1, len(ref.seq[rg]) - rp, qg ^ 1, len(query.seq[qg]) - qp, p)
    if fw[0] + rv[0] <= p.score:
        return None
    path = reverse_path(rv[1]) + "DR" * p.k + fw[1]
    a = _flip(rv[2], ref.seq) + seed_a + fw[2]
    b = _flip(rv[3], query.seq) + seed_b + fw[3]
    join = lambda parts: [x for x in _merged(parts) if x[2]]
    sections = cut_sections(path, join(a), join(b))
    return Result(fw[0] + rv[0] + p.m * p.k, path, sections, _track(sections, path))


def _merged(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for g, at, n in parts:
        if out and out[-1][0] == g and out[-1][1] + out[-1][2] == at:
            out[-1] = (g, out[-1][1], out[-1][2] + n)
        else:
            out.append((g, at, n))
    return out


def _track(sections: list[Section], path: str) -> list[tuple[int, int, int, int]]:
    """``(place, rgid, rpos, section)`` at each query letter of the path; a place is the query's gid and position in one number."""
    out = []
    for n, (aid, bid, apos, bpos, alen, blen, ppos) in enumerate(sections):
        r, q = apos, place(bid, bpos)
        for c in path[ppos : ppos + alen + blen]:
            if c == "D":
                out.append((q, aid, r, n))
                q += 1
            else:
                r += 1
    return out


def place(gid: int, pos: int) -> int:
    return (gid << 40) + pos


def covered(results: list[Result], q: int, g: int, r: int, width: int) -> bool:
    """Whether a result passes within the band of a seed at the seed's query position."""
    return any(g == tg and 0 <= t + width - r < 2 * width for res in results for tg, t, _ in res.by_place.get(q, ()))


def _begin(s: Section) -> tuple[int, ...]:
    aid, bid, apos, bpos, _, _, _ = s
    return aid, bid, apos, bpos


def _end(s: Section) -> tuple[int, ...]:
    aid, bid, apos, bpos, alen, blen, _ = s
    return aid, bid, apos + alen, bpos + blen


def compare(x: list[Section], y: list[Section], edge: Callable[[Section], tuple[int, ...]]) -> tuple[int, int]:
    """Which of two rows of sections is longer (1: ``x``, -1: ``y``, 0: neither), and how many edges they share from the first on.

    The longer has more sections; with as many, the longer path in the first section whose edges differ.
    """
    more = len(x) - len(y)
    for n, (s, t) in enumerate(zip(x, y)):
        if edge(s) != edge(t):
            more = more or s[4] + s[5] - t[4] - t[5]
            return (more > 0) - (more < 0), n
    return (more > 0) - (more < 0), min(len(x), len(y))


# What becomes of a new result, by which is longer at the head and at the tail (1: the new one).
OUTCOME = {
    (-1, -1): "next", (-1, 0): "old", (-1, 1): "new",
    (0, -1): "old", (0, 0): "old", (0, 1): "better",
    (1, -1): "old", (1, 0): "better", (1, 1): "better",
}


def settle(results: list[Result], new: Result, q: int, g: int, r: int, width: int) -> None:
    """Add the result that a seed at (``q``, ``g``, ``r``) has led to, or settle it with one that runs beside it.

    First come the results whose places on the reference at the seed's query position are nearest, that to the right
    before that to the left. One that shares neither edge of the new one's section through the seed has nothing to do
    with it; else ``OUTCOME`` says which stays, and "better" replaces the old one unless its score is higher. Then come
    results with a section that begins where the seed's section begins: one that does not begin later is replaced. What
    nothing settles is added.
    """
    root = next((n for p, tg, t, n in new.track if (p, tg, t) == (q, g, r)), 0)
    near = sorted((tg, t + width, i, n) for i, old in enumerate(results) for tg, t, n in old.by_place.get(q, ()))
    k = bisect_left(near, (g, r))
    for _, _, i, n in near[k : k + 1] + near[max(k - 1, 0) : k]:
        old = results[i]
        head, heads = compare(new.sections[root::-1], old.sections[n::-1], _begin)
        tail, tails = compare(new.sections[root:], old.sections[n:], _end)
        if not heads and not tails:
            continue
        outcome = OUTCOME[head, tail]
        if outcome == "new" or outcome == "better" and old.score <= new.score:
            results[i] = new
        elif outcome != "old":
            continue
        return
    for i, old in enumerate(results):
        for n, s in enumerate(old.sections):
            if _begin(s) == _begin(new.sections[root]) and compare(new.sections[root::-1], old.sections[n::-1], _begin)[0] <= 0:
                results[i] = new
                return
    results.append(new)


def align_read(ref: Sequences, query: Sequences, seeds: list[tuple], p: Params) -> list[Result]:
    """Results of one read or query graph, in order of discovery; ``seeds`` are ``(qgid, qpos, rgid, rpos, route[, qroute])`` in order."""
    results: list[Result] = []
    for qg, qp, rg, rp, route, *qroute in seeds:
        if covered(results, place(qg, qp), rg, rp, p.overlap):
            continue
        new = extend_seed(ref, query, rg, rp, qg, qp, p, route, *qroute)
        if new is not None:
            settle(results, new, place(qg, qp), rg, rp, p.overlap)
    return results


def _load(graph: Graph) -> Sequences:
    """A graph as driver values; for references whose size has been checked by the caller."""
    seq = {r["gid"]: r["seq"] for r in graph.sections.select("gid", "seq").collect()}
    succ = {r["gid"]: list(r["succ"]) for r in graph.successors().collect()}
    return Sequences(seq, succ)


MOST_REFERENCE = 1 << 28
MOST_INDEXED = 1 << 21


def _index(ref: Graph, held: Sequences, size: int, p: Params) -> screen.Index | None:
    """K-mers of the reference that occur ``p.repeat`` times at most, for the workers; None where there are more than ``MOST_INDEXED`` in all."""
    if 2 * size > MOST_INDEXED:
        return None
    kmers = checkpoint(graph_kmers(ref, p.k, both_strands=True))
    if kmers.count() > MOST_INDEXED:
        return None
    few = kmers.groupBy("kmer").agg(F.count("*").alias("hits")).filter(F.col("hits") <= p.repeat)
    rows = kmers.join(few, "kmer", "left_semi").select("kmer", "gid", "pos", "route").toArrow()
    return screen.Index.build(rows, held.seq, held.succ, p.k)


def _joined(ref: Graph, reads: DataFrame, p: Params, filters: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """``qid, seq, seeds`` by joins of k-mers, for references of any size."""
    kmers = graph_kmers(ref, p.k, both_strands=True)
    # either side is reduced to what the other has and written down, so each is enumerated a fixed number of times
    query = matched(query_kmers(reads, "read_ord", "seq", p.k), kmers)
    kmers = matched(kmers, query)
    few = counted_hits(kmers, query).filter(F.col("hits") <= p.repeat)
    known = query.join(few, "kmer")
    seeds = known.join(kmers, "kmer").select("qid", "qpos", F.col("gid").alias("rid"), F.lit(0).alias("dir"), F.col("pos").alias("rpos"), "route")
    kept = drop_adjacent(seeds.drop("route").distinct(), known.select("qid", "qpos").distinct())
    seeds = seeds.join(kept, ["qid", "qpos", "rid", "dir", "rpos"], "left_semi")
    if filters is not None:
        seeds = filters(seeds)
    rows = seeds.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("qpos", "rid", "rpos", "route"))).alias("seeds"))
    return rows.join(reads.select(F.col("read_ord").alias("qid"), "seq"), "qid").select("qid", "seq", "seeds")


def align(ref: Graph, reads: DataFrame, params: Params, filters: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``read_ord, ordinal, score, path, sections`` of reads (``read_ord, seq``) on a reference graph.

    The graph's text goes to every worker, so it may have ``MOST_REFERENCE``
    letters at most (checked). So do its k-mers up to ``MOST_INDEXED``: reads then
    find their seeds where they are read. Those of larger references, and seeds
    that ``filters`` takes as a frame, come from joins. Query sections are numbered
    0 (forward) and 1.
    """
    p = params.resolved()
    spark = ref.spark
    size = ref.total_length().first()["total_len"]
    if size > MOST_REFERENCE:
        raise ValueError(f"the reference has {size} letters; {MOST_REFERENCE} can be sent to the workers")
    graph = _load(ref)
    held = spark.sparkContext.broadcast(graph)
    index = _index(ref, graph, size, p) if filters is None else None
    if index is None:
        rows = _joined(ref, reads, p, filters)
    else:
        sent = spark.sparkContext.broadcast(index)
        rows = reads.select("read_ord", "seq")
        rows = rows.mapInArrow(lambda batches: screen.found(sent.value, batches, p), f"qid {dict(rows.dtypes)['read_ord']}, {screen.SEEDS}")
    # small rows, much work: spread by a fixed count, which the engine does not merge again
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)

    def run(batches):
        names = ("aid", "bid", "apos", "bpos", "alen", "blen", "ppos")
        section = pa.struct([(n, pa.int32()) for n in names])
        kinds = (("read_ord", pa.int64()), ("ordinal", pa.int32()), ("score", pa.int64()), ("path", pa.string()), ("sections", pa.list_(section)))
        for b in batches:
            out = []
            for row in b.to_pylist():
                seq = row["seq"].encode("ascii", "replace").decode().upper()  # a letter stays one letter
                query = Sequences({0: seq, 1: seq.translate(screen.FLIP)[::-1]}, {})
                found = align_read(held.value, query, [(0, s["qpos"], s["rid"], s["rpos"], s["route"]) for s in row["seeds"]], p)
                out += [(row["qid"], i, r.score, r.path, [dict(zip(names, s)) for s in r.sections]) for i, r in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return rows.mapInArrow(run, ALIGNMENT)


def align_graph(ref: Graph, query: Graph, params: Params) -> DataFrame:
    """Results of a query graph, as one read numbered 0, on a reference graph.

    A graph is one work item, as its results depend on each other; both graphs
    may have ``MOST_REFERENCE`` letters at most (checked).
    """
    p = params.resolved()
    for g in (ref, query):
        if g.total_length().first()["total_len"] > MOST_REFERENCE:
            raise ValueError(f"a graph has more than {MOST_REFERENCE} letters")
    spark = ref.spark
    held = spark.sparkContext.broadcast((_load(ref), _load(query)))
    kmers = graph_kmers(ref, p.k, both_strands=True)
    own = graph_kmers(query, p.k).select("kmer", F.col("gid").alias("qgid"), F.col("pos").alias("qpos"), F.col("route").alias("qroute"))
    own = matched(own, kmers)
    kmers = matched(kmers, own)
    few = counted_hits(kmers, own).filter(F.col("hits") <= p.repeat)
    seeds = own.join(few.select("kmer"), "kmer").join(kmers, "kmer").select("qgid", "qpos", "gid", "pos", "route", "qroute")
    rows = seeds.groupBy(F.lit(0).alias("one")).agg(F.array_sort(F.collect_list(F.struct("qgid", "qpos", "gid", "pos", "route", "qroute"))).alias("seeds"))

    def run(batches):
        a, b = held.value
        names = ("aid", "bid", "apos", "bpos", "alen", "blen", "ppos")
        for batch in batches:
            for seeds in batch["seeds"]:
                todo = [(s["qgid"], s["qpos"], s["gid"], s["pos"], list(s["route"]), list(s["qroute"])) for s in seeds]
                found = align_read(a, b, todo, p)
                yield pd.DataFrame([(0, i, r.score, r.path, [dict(zip(names, s)) for s in r.sections]) for i, r in enumerate(found)], columns=["read_ord", "ordinal", "score", "path", "sections"])

    return rows.select("seeds").mapInPandas(run, ALIGNMENT)


def gapless(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``(id, a, b)`` whose first window matches in more than ``threshold`` places."""

    def run(batches):
        for b in batches:
            yield b[[gapless_count(s, t) > threshold for s, t in zip(b["a"], b["b"])]]

    return pairs.mapInPandas(run, pairs.schema)
