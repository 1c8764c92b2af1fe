"""Exact Jaccard self-join on word shingles by T-occurrence search.

A document's set holds the 64-bit hashes of its distinct five-word shingles
(words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z in lower case); a shorter document
has its whole word sequence as one. Two documents link when
``100 * |A & B| >= 80 * |A | B|``.

1. One pass gives each document's set size and digest, and counts shingles in a
   sketch of fixed size over all documents. The sketch orders shingles: rare
   ones first, the more frequent the later. Any order is exact; this one keeps
   long inverted lists out of what follows.
2. A document of ``n`` shingles is listed under its first
   ``n - ceil(0.8 n) + 1`` shingles. Linked documents share one of them, and one
   that is among the first ``n - ceil(8 n / 9) + 1`` of the smaller. Equal sets
   are one entry; lists are parted by bands of size, as linked sizes differ by a
   fifth at most.
3. The documents of one list and band go to the shard named by the one of them
   with the least hash, so lists over the same documents fall together and each
   document is sent to few shards. Shards over ``TILE`` documents are compared in
   tiles of bounded size. There, histograms of the sets (a byte for every four to
   eight shingles) first bound each pair's overlap from above; only documents with
   a partner that the bound allows go on with their texts.
4. In a tile, T-occurrence search by DivideSkip: for each document the long
   inverted lists of its shingles are set aside, the short ones are merged and
   counted, and documents that could still reach the overlap are looked up in
   the long lists by binary search. A spanning forest of the links leaves it.
5. Components of the forests, over set digests, give each document its group.

Nulls: null or wordless texts have the empty set and link with nothing, nor do
rows with a null doc_id, whose component is null. Repeated rows are equal sets.
Rows that share a doc_id with other texts are joined by their own texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise, slices
from .components import components
from .neardup import runs

WORDS = 5
SKETCH = 1 << 18
TILE = 512
COMMON = 1024
MASK = 1 << 23
_CHUNK = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """Hashed shingle sets of texts."""

    def __init__(self) -> None:
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_M, n), _powers(_INVERSE, n)

    def words(self, text: str) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, taken from prefix sums, then mixed."""
        raw = text.encode().lower()
        out, at = [], 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= _CHUNK else at + _CHUNK
            while end < len(raw) and not _BLANK[raw[end]]:
                end += 1
            out.append(self._words(np.frombuffer(raw, np.uint8)[at:end]))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _words(self, b: np.ndarray) -> np.ndarray:
        if len(b) > len(self.up):
            self._grow(2 * len(b))
        edge = np.diff(np.concatenate([[True], _BLANK[b], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))

    def set(self, text: str) -> np.ndarray:
        """The sorted distinct shingles of a text."""
        w = self.words(text)
        if not len(w):
            return w
        k = min(WORDS, len(w))
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = (h ^ w[i : i + n]) * _M
            h ^= h >> np.uint64(29)
        return np.unique(h)


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= 80 * (a + b - common)


def least_overlap(a, b):
    """Smallest overlap with which sets of ``a`` and ``b`` shingles link: ceil(4 (a + b) / 9)."""
    return -(-4 * (a + b) // 9)


def digest(s: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None


def histogram(s: np.ndarray) -> bytes:
    """Shingles counted by their top bits, one byte a cell; empty where a cell is too full."""
    bits = max(len(s).bit_length() - 3, 0)
    cells = np.bincount((s >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64), minlength=1 << bits)
    return cells.astype(np.uint8).tobytes() if cells.max(initial=0) < 256 else b""


def profile(docs: DataFrame) -> DataFrame:
    """``doc_id, n, digest, cells`` for each row, and rows ``bucket, count`` of the sketch, as one table (the others null)."""

    def run(batches):
        shingler, counts = Shingler(), np.zeros(SKETCH, np.int64)
        for b in slices(batches):
            n, own, cells = [], [], []
            for t in b.column(1).to_pylist():
                s = shingler.set(t)
                cells.append(histogram(s))
                counts += np.bincount((s >> np.uint64(46)).astype(np.int64), minlength=SKETCH) if len(s) > 20_000 else 0
                if len(s) <= 20_000:
                    # distinct shingles of one text may share a bucket
                    np.add.at(counts, (s >> np.uint64(46)).astype(np.int64), 1)
                n.append(len(s))
                own.append(digest(s))
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(n)), b.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(cells, pa.binary()), none, none], names=names)
        at = np.flatnonzero(counts)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            k, none = len(part), pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([False] * k), none, none, pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], names=names)

    names = ["is_doc", "doc_id", "n", "digest", "cells", "bucket", "count"]
    return documents(docs).mapInArrow(run, "is_doc boolean, doc_id long, n long, digest string, cells binary, bucket long, count long")


def levels(sketch: DataFrame) -> np.ndarray:
    """Level of each bucket of the sketch: 0 for what chance explains, then by doublings of the excess."""
    total = sketch.groupBy("bucket").agg(F.sum("count").alias("n")).toArrow()
    counts = np.zeros(SKETCH)
    counts[total.column("bucket").to_numpy()] = total.column("n").to_numpy()
    mean = counts.mean()
    excess = (counts - mean) / (6 * max(1.0, mean**0.5))
    return np.where(excess > 1, 1 + np.floor(np.log2(np.maximum(excess, 1))), 0).astype(np.uint8)


def halves(mark: bytes) -> tuple[int, int]:
    """A 128-bit digest as two signed numbers."""
    return int.from_bytes(mark[:8], "big", signed=True), int.from_bytes(mark[8:], "big", signed=True)


def prefixes(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """``key, n, d1, d2, first, level``: each set under the shingles of its prefix.

    ``d1, d2`` are the set's digest, ``first`` marks the smaller prefix and
    ``level`` is that of the key's bucket. A task lists equal sets once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(level)
    names = ["key", "n", "d1", "d2", "first", "level"]

    def run(batches):
        level, shingler = sent.value, Shingler()
        seen: set[bytes] = set()
        for b in slices(batches):
            cols = [[] for _ in names]
            held = 0
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingler.set(t)
                if doc_id is None or not len(s):
                    continue
                mark = xxhash.xxh3_128_digest(s.tobytes())
                if mark in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(mark)
                n = len(s)
                p, q = n - -(-4 * n // 5) + 1, n - -(-8 * n // 9) + 1
                l = level[(s >> np.uint64(46)).astype(np.int64)]
                low = np.flatnonzero(l == 0)
                at = low[:p] if len(low) >= p else np.lexsort((s, l))[:p]
                d1, d2 = halves(mark)
                for c, v in zip(cols, (s[at].view(np.int64), np.full(p, n, np.int32), np.full(p, d1, np.int64), np.full(p, d2, np.int64), np.arange(p) < q, l[at].astype(np.int8))):
                    c.append(v)
                held += p
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)
                    cols, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)

    return documents(docs).mapInArrow(run, "key long, n int, d1 long, d2 long, first boolean, level byte")


def shards(listed: DataFrame) -> DataFrame:
    """``shard, band, d1, d2``: where each set with a possible partner is to be compared.

    A list of level ``l`` is dealt in ``2**l`` parts by digest, so no list, however
    long, is one task's work. Parts agree on a lead and a count through one small
    row each.
    """
    salt = F.col("d1").bitwiseAND(F.expr("shiftleft(1L, level) - 1"))
    sets = listed.withColumn("salt", salt).repartition("key", "salt").groupBy("key", "salt", "level", "n", "d1", "d2").agg(F.max("first").alias("first"))
    sets = sets.withColumn("m", F.count("*").over(Window.partitionBy("key", "salt"))).filter("m > 1 or level > 0")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + F.lit(1e-9)).cast("int")
    # a document may be the larger of a link in its own band, and the smaller in its own or the next
    places = F.when(F.col("first"), F.array(band, band + 1)).otherwise(F.array(band))
    rows = sets.withColumn("band", F.explode(places)).withColumn("own", F.col("band") == band)
    group = Window.partitionBy("key", "salt", "band")
    rows = rows.select(
        "key",
        "salt",
        "level",
        "band",
        "d1",
        "d2",
        F.min(F.struct("d1", "d2")).over(group).alias("lead"),
        F.count("*").over(group).alias("k"),
        F.max("first").over(group).alias("a"),
        F.max("own").over(group).alias("b"),
    )
    rows = materialise(rows.filter("level > 0 or (k > 1 and a and b)"))
    short = rows.filter("level = 0").select(F.col("lead.d1").alias("shard"), "band", "d1", "d2")
    parts = rows.filter("level > 0").select("key", "salt", "level", "band", "lead", "k", "a", "b").distinct()
    whole = parts.groupBy("key", "level", "band").agg(F.min("lead").alias("top"), F.sum("k").alias("k"), F.max("a").alias("a"), F.max("b").alias("b"))
    whole = whole.filter("k > 1 and a and b").select("key", "band", F.col("top.d1").alias("shard"), F.explode(F.expr("sequence(0L, shiftleft(1L, level) - 1)")).alias("salt"))
    long = rows.filter("level > 0").select("key", "salt", "band", "d1", "d2").join(whole, ["key", "salt", "band"]).select("shard", "band", "d1", "d2")
    return short.unionByName(long).distinct()


def named(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """``shard, band, doc_id``: sets of ``placed`` by the least document that has them."""
    return placed.join(classes.select("d1", "d2", F.col("least").alias("doc_id")), ["d1", "d2"]).select("shard", "band", "doc_id")


class Tile:
    """Inverted lists over the sets of one tile."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.m = len(sets)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(self.m), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.posting = flat[order], owner[order]
        self.terms, self.starts = np.unique(flat, return_index=True)
        self.lengths = np.diff(np.append(self.starts, len(flat)))
        # (list, document) as one sorted number, for binary probes
        self.probe = np.repeat(np.arange(len(self.terms)), self.lengths) * self.m + self.posting

    def search(self, q: int, among: np.ndarray) -> np.ndarray:
        """Documents of ``among`` (marks by number) that link with document ``q``."""
        n = int(self.sizes[q])
        fit = among & (5 * self.sizes >= 4 * n) & (5 * n >= 4 * self.sizes)
        if not fit.any():
            return np.zeros(0, np.int64)
        lists = np.searchsorted(self.terms, self.sets[q])
        lengths = self.lengths[lists]
        shared = lists[lengths > 1]
        least = -(-4 * n // 5)  # overlap with the smallest partner that fits
        if len(shared) < least:
            return np.zeros(0, np.int64)
        lengths = self.lengths[shared]
        order = np.argsort(lengths, kind="stable")
        longest = int(lengths.max())
        skip = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)), len(shared) - 1)
        cut = len(order) - skip
        short, long = shared[order[:cut]], shared[order[cut:]]
        # merge the short lists
        spans = self.lengths[short]
        at = np.repeat(self.starts[short] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        counts = np.bincount(self.posting[at], minlength=self.m)
        need = least_overlap(n, self.sizes)
        found = np.flatnonzero(fit & (counts + len(long) >= need))
        if not len(found):
            return found
        # binary probes of the long ones
        keys = long[:, None] * self.m + found
        where = np.minimum(np.searchsorted(self.probe, keys), len(self.probe) - 1)
        total = counts[found] + (self.probe[where] == keys).sum(0)
        return found[total >= need[found]]


def forest(sets: list[np.ndarray], left: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of the documents marked ``left`` with all documents of the tile."""
    tile, parent = Tile(sets), np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    number = np.arange(len(sets))
    for q in np.flatnonzero(left):
        among = (number > q) | ~left
        for c in tile.search(int(q), among):
            a, b = root(int(q)), root(int(c))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(q), int(c)))
    return out


def tiles(placed: DataFrame) -> DataFrame:
    """``shard, band, i, j, left, doc_id``: rows of tile (i, j), i <= j, in which part i meets parts i and j."""
    sizes = placed.groupBy("shard", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = placed.join(sizes, ["shard", "band"])
    own = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own <= k).alias("left")))
    return rows.select("shard", "band", "doc_id", F.explode(at).alias("at")).select("shard", "band", "at.i", "at.j", "at.left", "doc_id")


def possible(sizes: np.ndarray, cells: list[bytes], left: np.ndarray) -> np.ndarray:
    """Documents of a tile with a partner whose overlap, bounded by the histograms, may reach what a link takes."""
    m = len(sizes)
    known = np.array([len(c) for c in cells])
    keep = known == 0
    if keep.any():  # no histogram, no bound: all of a fitting size stay
        for q in np.flatnonzero(keep):
            keep |= (5 * sizes >= 4 * sizes[q]) & (5 * sizes[q] >= 4 * sizes)
    for width in np.unique(known[known > 0]):
        at = np.flatnonzero((known == width) | (known == 2 * width))
        table = np.zeros((len(at), width), np.uint16)
        for k, i in enumerate(at):
            c = np.frombuffer(cells[i], np.uint8)
            table[k] = c if len(c) == width else c.reshape(width, 2).sum(1)
        n, side = sizes[at], left[at]
        exact = known[at] == width
        for k in range(len(at)):
            if not side[k]:
                continue
            # each pair once; where both are twice as wide, their own width decides
            fit = (5 * n >= 4 * n[k]) & (5 * n[k] >= 4 * n) & ((np.arange(len(at)) > k) | ~side) & (exact | exact[k])
            near = np.flatnonzero(fit)
            if len(near):
                bound = np.minimum(table[near], table[k]).sum(1)
                hit = near[bound >= least_overlap(n[k], n[near])]
                if len(hit):
                    keep[at[hit]] = keep[at[k]] = True
    return keep if m else np.zeros(0, bool)


def screen(placed: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of ``placed`` whose document has a possible partner in its tile, by sizes and histograms."""
    rows = tiles(placed).join(own.filter("doc_id is not null and n > 0").select("doc_id", "n", "cells"), "doc_id").select("shard", "band", "i", "j", "left", "doc_id", "n", "cells")

    def run(batches):
        for t in runs(batches, 4):
            keep = possible(t.column("n").to_numpy(), t.column("cells").to_pylist(), t.column("left").to_numpy(zero_copy_only=False))
            if keep.any():
                yield from t.select(["shard", "band", "doc_id"]).filter(pa.array(keep)).combine_chunks().to_batches()

    keys = ["shard", "band", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "shard long, band int, doc_id long").distinct()


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be among ``ids``, by a bit mask of fixed size (``MASK`` bits, so 2 MB are broadcast).

    It spares the shuffle of texts that no one asks for; a join decides afterwards.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MASK))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    mask = ids.select(word.alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("_w").agg(F.bit_or("b").alias("_bits"))
    marked = docs.withColumn("_word", word).join(F.broadcast(mask), F.col("_word") == F.col("_w"))
    return marked.filter(F.call_function("getbit", F.col("_bits"), bit) == 1).select(*docs.columns)


def links(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``a, b``: digests of linked sets, a spanning forest for each tile."""
    texts = only(documents(docs).dropna(subset=["doc_id"]), placed)
    full = tiles(placed).join(texts, "doc_id").select("shard", "band", "i", "j", "left", "text")

    def run(batches):
        shingler = Shingler()
        for t in runs(batches, 4):
            sets, left, seen = [], [], {}
            for mark, text in zip(t.column("left").to_pylist(), t.column("text").to_pylist()):
                s = shingler.set(text)
                d = digest(s)
                if d is not None and d not in seen:
                    seen[d] = len(sets)
                    sets.append(s)
                    left.append(mark)
            if len(sets) > 1:
                found = forest(sets, np.array(left))
                names = list(seen)
                yield pa.RecordBatch.from_pydict({"a": pa.array([names[a] for a, _ in found], pa.string()), "b": pa.array([names[b] for _, b in found], pa.string())})

    keys = ["shard", "band", "i", "j"]
    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a string, b string")


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    known = materialise(profile(docs))
    level = levels(known.filter("not is_doc"))
    own = known.filter("is_doc").select("doc_id", "n", "digest")
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    classes = own.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumns({"d1": half(1), "d2": half(17)}))
    placed = named(shards(prefixes(docs, level)), classes.filter("least is not null"))
    placed = materialise(screen(materialise(placed), known.filter("is_doc")))
    groups = components(links(docs, placed))
    groups = groups.select(F.col("node").alias("digest"), "component")
    first = groups.join(classes, "digest").groupBy("component").agg(F.min("least").alias("group_id"))
    grouped = classes.join(groups.join(first, "component").select("digest", "group_id"), "digest", "left")
    grouped = materialise(grouped.select(F.col("digest").alias("_digest"), F.coalesce("group_id", "least").alias("group_id"), "copies"))
    # sets that a COMMON-th of all rows have, COMMON of them at most, are told to every task; a join finds the others
    total = classes.agg(F.sum("copies")).first()[0] or 0
    common = F.col("copies") > max(total / COMMON, 1)
    often = grouped.filter(common).select("_digest", F.col("group_id").alias("_often"))
    rows = own.join(F.broadcast(often), F.col("digest") == F.col("_digest"), "left").drop("_digest")
    rest = rows.filter("_often is null").join(grouped.filter(~common), F.col("digest") == F.col("_digest"), "left")
    both = rows.filter("_often is not null").select("doc_id", "n", F.col("_often").alias("group_id")).unionByName(rest.select("doc_id", "n", "group_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first (least doc_id) of its group; rows with a null id stay."""
    extra = join(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(extra, docs["doc_id"] == extra["_gone"], "left_anti")
