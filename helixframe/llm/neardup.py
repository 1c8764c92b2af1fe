"""Near duplicates among embeddings by sorted projection passes.

Each pass hashes a vector to the signs of ``BITS`` random projections, orders all
vectors lexicographically by that key, and compares each with the others of its
window in that order: blocks of ``BLOCK`` ranks and the ``HALO`` ranks that follow.
Pairs whose cosine (double precision) reaches the threshold are links; blocks
send a spanning forest of them, and forests are united across passes. Inside each
united class the direct links of every vector are then counted by comparing the
class with itself, tile by tile, so a link counts whichever pass met it; only
counts leave a tile.

The number of passes comes from the table. A sample of ``PROBES`` vectors gets a
partner each at the threshold's cosine, in a random direction; how many vectors of
the table lie between the two keys of a pair is counted over the whole table, pass
by pass, until the expected share of pairs that no window has joined is ``MISS`` at
most. Larger and denser tables so get more passes (``PASSES`` at least), in groups
of ``PASSES``, whose sorted keys are removed before the next group's are made.

Equal vectors are one class from the start, represented once, so a large group of
copies costs no more than one vector.

Ties: equal keys are ordered by vec_id; a cosine equal to the threshold links. An
empty table gives no rows. Long vectors cost in proportion to their length.

Nulls: a vector that is null, empty, zero, or has null or non-finite components
links with nothing and is its own component; so is one with a null id, whose
component is null. Vectors of different length do not link. Rows that share a
vec_id are one vector for components; each still gives its result row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove, shared_dir
from .components import components

THRESHOLD = 0.9
PASSES = 10
BITS = 60
BLOCK, HALO = 1536, 512
TILE = 512
SEED = 90_210
PROBES, TRIAL, MISS = 512, 16, 0.01


def units(column: pa.Array) -> np.ndarray:
    """Unit rows of an Arrow list column whose vectors all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sort_keys(x: np.ndarray, passes: int, first: int = 0) -> np.ndarray:
    """Key of each row in each of ``passes`` passes from ``first`` on: the signs of its projections, first sign highest."""
    g = np.random.default_rng([SEED, x.shape[1]])
    out = np.zeros((len(x), passes), np.int64)
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for p in range(first + passes):
        signs = g.standard_normal((x.shape[1], BITS))
        if p >= first:
            out[:, p - first] = (x @ signs > 0) @ weight
    return out


def partners(x: np.ndarray, threshold: float) -> np.ndarray:
    """A unit vector at cosine ``threshold`` to each unit row, in a random direction."""
    u = np.random.default_rng([SEED, 1, x.shape[1]]).standard_normal(x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    return threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * u


def key_bins(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Place of each key among sorted bounds: ``2 i`` before bound ``i``, ``2 i + 1`` equal to it."""
    return np.searchsorted(bounds, keys, "left") + np.searchsorted(bounds, keys, "right")


def meeting(low: np.ndarray, high: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Chance that a window holds both ends of each pair of keys, by the table's counts of :func:`key_bins`."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    i, j = np.searchsorted(bounds, low), np.searchsorted(bounds, high)
    apart = sums[2 * j + 2] - sums[2 * i + 1]  # ties count as between, so never too hopeful
    return np.clip((BLOCK + HALO - apart) / BLOCK, 0.0, 1.0)


def forest(x: np.ndarray, y: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (row of x, row of y) that span what the rows of ``x`` link to in ``y``; ``y`` begins with ``x``."""
    parent = list(range(len(y)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for lo in range(0, len(x), 512):
        i, j = np.nonzero(x[lo : lo + 512] @ y.T >= threshold)
        i += lo
        for a, b in zip(i[j > i].tolist(), j[j > i].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[rb] = ra
                out.append((a, b))
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in the first ``keys`` columns, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            own = tuple(k[lo])
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _classes(rows: DataFrame) -> DataFrame:
    """``rep, n, vec``: usable vectors, equal ones as one with its least id and its number of rows."""
    ok = "id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)"
    return rows.filter(ok).groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def _map_runs(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    def run(batches):
        for table in runs(batches, len(keys)):
            out = kernel(table.combine_chunks())
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def needed_passes(classes: DataFrame, threshold: float) -> int:
    """Passes after which the probes' expected share of unmet pairs is ``MISS`` at most; ``PASSES`` at least.

    The driver receives ``PROBES`` vectors, and a count for each place among their keys.
    """
    probes: dict[int, list] = {}
    for r in classes.select("vec", "vec_key").orderBy("vec_key").limit(PROBES).collect():
        probes.setdefault(len(r["vec"]), []).append(r["vec"])
    sides = {}
    for d, rows in probes.items():
        x = units(pa.array(rows, pa.list_(pa.float64())))
        sides[d] = x, partners(x, threshold)
    vectors = classes.select(F.size("vec").alias("dim"), "vec")
    unmet = {d: np.ones(len(x)) for d, (x, _) in sides.items()}
    done = 0
    while sides:
        ends = {d: (sort_keys(x, TRIAL, done), sort_keys(y, TRIAL, done)) for d, (x, y) in sides.items()}
        bounds = {d: [np.unique(np.concatenate([a[:, p], b[:, p]])) for p in range(TRIAL)] for d, (a, b) in ends.items()}

        def places(batches, bounds=bounds, done=done):
            for batch in batches:
                sizes = batch.column("dim").to_numpy()
                for d in set(np.unique(sizes).tolist()) & bounds.keys():
                    k = sort_keys(units(batch.filter(pa.array(sizes == d)).column("vec")), TRIAL, done)
                    for p in range(TRIAL):
                        at, n = np.unique(key_bins(k[:, p], bounds[d][p]), return_counts=True)
                        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(len(at), d, np.int32)), "pass": pa.array(np.full(len(at), p, np.int32)), "bin": pa.array(at, pa.int32()), "n": pa.array(n, pa.int64())})

        counts = {d: [np.zeros(2 * len(b) + 1, np.int64) for b in own] for d, own in bounds.items()}
        found = vectors.mapInArrow(places, "dim int, pass int, bin int, n long")
        # bounded by the probes: TRIAL * (4 * PROBES + 1) rows at most for one dimension
        for r in found.groupBy("dim", "pass", "bin").agg(F.sum("n").alias("n")).collect():
            counts[r["dim"]][r["pass"]][r["bin"]] = r["n"]
        for p in range(TRIAL):
            for d, (a, b) in ends.items():
                low, high = np.minimum(a[:, p], b[:, p]), np.maximum(a[:, p], b[:, p])
                unmet[d] *= 1 - meeting(low, high, bounds[d][p], counts[d][p])
            done += 1
            if done >= PASSES and np.concatenate(list(unmet.values())).mean() <= MISS:
                return done
    return PASSES


def candidate_links(classes: DataFrame, threshold: float, passes: int) -> DataFrame:
    """Links ``a, b`` between representatives: forests of all blocks of all passes, ``PASSES`` passes at a time."""
    if passes <= PASSES:
        return _pass_links(classes, threshold, 0, passes, None)
    out = None
    for first in range(0, passes, PASSES):
        path = shared_dir(classes.sparkSession)
        links = materialise(_pass_links(classes, threshold, first, min(PASSES, passes - first), path))
        remove(classes.sparkSession, path)
        out = links if out is None else out.unionByName(links)
    return out


def _pass_links(classes: DataFrame, threshold: float, first_pass: int, passes: int, path: str | None) -> DataFrame:
    """Links of the blocks of some passes; their sorted keys are written to ``path``."""

    def keys(batches):
        for b in batches:
            sizes = np.array(b.column("dim").to_pylist(), np.int64)
            for d in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == d))
                k = sort_keys(units(own.column("vec")), passes, first_pass)
                for p in range(passes):
                    yield pa.RecordBatch.from_pydict({"dim": own.column("dim"), "pass": pa.array(np.full(len(k), p, np.int32)), "key": pa.array(k[:, p]), "rep": own.column("rep"), "vec_key": own.column("vec_key")})

    dealt = classes.select(F.size("vec").alias("dim"), "rep", "vec_key", "vec").mapInArrow(keys, "dim int, pass int, key long, rep long, vec_key long")
    order = ["dim", "pass", "key", "rep", "vec_key"]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt, path)
    part = F.shiftright("at", 33)
    # one row a partition
    counts = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    if not total:
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    first = dealt.sparkSession.createDataFrame(list(starts.items()), "p long, start long")
    ranked = dealt.withColumn("p", part).join(F.broadcast(first), "p").withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    block = F.floor(F.col("rank") / BLOCK)
    halo = F.when((F.col("rank") % BLOCK < HALO) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    placed = ranked.select(F.explode(halo).alias("block"), "rank", "dim", "pass", "rep", "vec_key")
    # vectors go straight to the blocks that compare them; until then keys and ids stand for them
    blocks = placed.join(classes.select("rep", "vec_key", "vec"), ["rep", "vec_key"]).select("block", "rank", "dim", "pass", "rep", "vec")

    def link(t):
        block = t.column("block")[0].as_py()
        rank = t.column("rank").to_numpy()
        group = np.column_stack([t.column("dim").to_numpy(), t.column("pass").to_numpy()])
        rep = t.column("rep").to_numpy()
        a, b = [], []
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(rank)]
        for lo, hi in zip(cuts, cuts[1:]):
            y = units(_chunk(t.column("vec").slice(lo, hi - lo)))
            own = int((rank[lo:hi] // BLOCK == block).sum())
            for i, j in forest(y[:own], y, threshold):
                a.append(rep[lo + i])
                b.append(rep[lo + j])
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _map_runs(blocks, ["block"], ["rank"], link, "a long, b long")


def _direct(members: DataFrame, threshold: float) -> DataFrame:
    """``rep, vec_key, links``: rows (copies counted) that each class representative links to in its component.

    A component of ``m`` classes is compared in ``(m / TILE)**2`` tiles of bounded size, dealt over all tasks.
    """
    sized = members.join(members.groupBy("component").agg(F.count("*").alias("m")), "component")
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    own = F.pmod(F.xxhash64("rep", "vec_key"), tiles).cast("int")
    tall = sized.select("component", own.alias("i"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("j"), F.lit(0).alias("side"), "rep", "vec_key", "n", "vec")
    wide = sized.select("component", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("i"), own.alias("j"), F.lit(1).alias("side"), "rep", "vec_key", "n", "vec")

    def count(t):
        side = t.column("side").to_numpy()
        vec = _chunk(t.column("vec"))
        sizes = vec.value_lengths().to_numpy()
        total = np.zeros(len(side), np.int64)
        for d in np.unique(sizes):
            left, right = np.flatnonzero((side == 0) & (sizes == d)), np.flatnonzero((side == 1) & (sizes == d))
            if len(left) and len(right):
                y, n = units(vec.take(pa.array(right))), t.column("n").to_numpy()[right]
                for lo in range(0, len(left), 512):
                    part = left[lo : lo + 512]
                    total[part] += (units(vec.take(pa.array(part))) @ y.T >= threshold) @ n
        left = np.flatnonzero(side == 0)
        return pa.RecordBatch.from_pydict({k: _chunk(t.column(k)).take(pa.array(left)) for k in ("rep", "vec_key")} | {"links": pa.array(total[left])})

    tile = _map_runs(tall.unionByName(wide), ["component", "i", "j"], ["side"], count, "rep long, vec_key long, links long")
    return tile.groupBy("rep", "vec_key").agg(F.sum("links").alias("links"))


def deduplicate(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``).

    ``passes`` None takes what :func:`needed_passes` finds for the table.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    classes = materialise(_classes(rows).withColumn("vec_key", F.xxhash64("vec")))
    found = components(candidate_links(classes, threshold, passes or needed_passes(classes, threshold)))
    found = found.select(F.col("node").alias("rep"), "component")
    members = materialise(classes.join(found, "rep").select("component", "rep", "vec_key", "n", "vec"))
    direct = _direct(members, threshold).join(found, "rep").select("rep", "vec_key", "links", "component")
    # small result rows only: classes, with what they link to beside their own copies
    known = classes.select("rep", "vec_key", "n", "vec").join(direct, ["rep", "vec_key"], "left")
    known = known.select(
        F.col("vec").alias("v"), "vec_key", (F.coalesce("links", "n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    both = rows.withColumn("k", F.xxhash64("vec")).join(known, (F.col("k") == F.col("vec_key")) & (F.col("vec") == F.col("v")) & F.col("id").isNotNull(), "left")
    return both.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
