"""Seeds of reads on a reference that the worker holds, and the screen that leaves out those that lead to no result.

A task takes the letters of many reads as one array: all windows as 2-bit codes, looked up in the sorted codes of the
reference, so no window becomes a row. The screen never drops a seed that reaches the score threshold: a side that fails
the gapless filter scores 0, any other at most a match a letter, and then as much as the X-drop extension scores, filled
for many seeds at once. What the screen cannot tell (linked sections, long extensions) stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions.params import Params
from .align import CODES, LOW, reach

LETTERS = 1 << 22  # of reads worked on at once; a longer read goes alone
PAIRS = 1 << 11  # extensions filled at once
ROWS = 512  # letters of the reference in which such an extension is settled, or stays
WIDTH = 16  # letters of the gapless filter's window

_TWO = np.full(256, 4, np.uint8)
for _n, _c in enumerate("ACGT"):
    _TWO[ord(_c)] = _n
FLIP = str.maketrans("ACGTRYKMBVDH", "TGCAYRMKVBHD")
_UPPER = CODES[[ord(chr(c).upper()) if c < 128 else 0 for c in range(256)]]
_FLIPPED = CODES[[ord(chr(c).upper().translate(FLIP)) if c < 128 else 0 for c in range(256)]]


def codes_of(text: np.ndarray, k: int) -> np.ndarray:
    """Each window of ``k`` letters (0 to 3) as a number, the first letter highest."""
    kind = np.uint32 if k <= 16 else np.uint64
    one = (text & 3).astype(kind)
    out, size = one, 1
    for bit in bin(k)[3:]:
        out = (out[: len(out) - size] << kind(2 * size)) | out[size:]
        size *= 2
        if bit == "1":
            out = (out[: len(out) - 1] << kind(2)) | one[size:]
            size += 1
    return out


@dataclass
class Index:
    """K-mers of a reference: sorted codes, the places of each in order of (gid, pos, route), and the sections' letters."""

    k: int
    codes: np.ndarray
    start: np.ndarray
    gid: np.ndarray
    pos: np.ndarray
    route: np.ndarray
    #: the different routes, in order
    routes: list[tuple[int, ...]]
    #: first place of each gid in ``letters``, which has an empty set between two sections
    base: np.ndarray
    size: np.ndarray
    linked: np.ndarray
    letters: np.ndarray
    maybe: np.ndarray

    @classmethod
    def build(cls, rows: pa.Table, seq: dict[int, str], succ: dict[int, list[int]], k: int) -> Index:
        """From ``kmer, gid, pos, route`` and the text and successors of each gid."""
        text = np.frombuffer("".join(rows["kmer"].to_pylist()).encode(), np.uint8).reshape(-1, k)
        kind = np.uint32 if k <= 16 else np.uint64
        codes = np.zeros(len(text), kind)
        for c in _TWO[text].T:
            codes = (codes << kind(2)) | c.astype(kind)
        gid, pos = rows["gid"].to_numpy().astype(np.int64), rows["pos"].to_numpy().astype(np.int64)
        route = [tuple(r) for r in rows["route"].to_pylist()]
        routes = sorted(set(route))
        number = {r: n for n, r in enumerate(routes)}
        route = np.array([number[r] for r in route], np.int64)
        order = np.lexsort((route, pos, gid, codes))
        keys, start = np.unique(codes[order], return_index=True)
        gids = max(seq, default=-1) + 1
        size = np.array([len(seq.get(g, "")) for g in range(gids)], np.int64)
        letters = np.frombuffer("".join(seq.get(g, "") + "\0" for g in range(gids)).encode("latin-1", "replace"), np.uint8)
        maybe = np.zeros(1 << max(16, min(26, (32 * len(keys)).bit_length())), bool)
        out = cls(
            k, keys, np.append(start, len(codes)), gid[order], pos[order], route[order], routes,
            np.cumsum(size + 1) - size - 1, size, np.array([bool(succ.get(g)) for g in range(gids)], bool), CODES[letters], maybe,
        )
        maybe[out._bucket(keys)] = True
        return out

    def _bucket(self, codes: np.ndarray) -> np.ndarray:
        bits = self.maybe.size.bit_length() - 1
        if codes.dtype == np.uint32:
            return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def seeds(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seeds of reads laid end to end: place in ``text`` and row of the index, in order; none whose left neighbour on the diagonal is one."""
        none = np.zeros(0, np.int64)
        if len(text) < self.k or not len(self.codes):
            return none, none
        two = _TWO[text]
        codes = codes_of(two, self.k)
        at = np.flatnonzero(self.maybe[self._bucket(codes)])
        found = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        own = self.codes[found] == codes[at]
        at, found = at[own], found[own]
        # windows lie in one read and have no other letters
        own = at + self.k <= ends[np.searchsorted(ends, at, "right")]
        if (two > 3).any():
            other = np.append(0, np.cumsum(two > 3))
            own &= other[at + self.k] == other[at]
        at, found = at[own], found[own]
        many = self.start[found + 1] - self.start[found]
        row = np.repeat(self.start[found] - np.cumsum(many) + many, many) + np.arange(many.sum())
        at = np.repeat(at, many)
        spot = (at << 30) + self.base[self.gid[row]] + self.pos[row]
        # sorted already, but for routes, which are alike here
        left = np.searchsorted(spot, spot - (1 << 30) - 1)
        fresh = spot[np.minimum(left, len(spot) - 1)] != spot - (1 << 30) - 1
        return at[fresh], row[fresh]


@dataclass
class Side:
    """One side of each seed: the first letters beyond it and how many there are, of the reference and of the read."""

    a: np.ndarray
    alen: np.ndarray
    b: np.ndarray
    blen: np.ndarray
    step: int  # along the read
    linked: np.ndarray


def window(letters: np.ndarray, at: np.ndarray, size: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """``n`` letters from each place, a row a letter; beyond ``size`` empty sets."""
    i = np.arange(n)[:, None]
    return np.where(i < size, letters[np.clip(at + step * i, 0, len(letters) - 1)], 0)


def most(index: Index, read: np.ndarray, side: Side, p: Params) -> np.ndarray:
    """What each side can score at most, by its letters and the gapless filter."""
    x, y = window(index.letters, side.a, side.alen, WIDTH), window(read, side.b, side.blen, WIDTH + 1, side.step)
    hit = (x & y[:WIDTH]) | (x & y[1:])
    hit[1:] |= x[1:] & y[: WIDTH - 1]
    failed = (hit > 0).sum(axis=0) <= p.gapless
    # a window that goes on in other sections is not known here
    failed &= (np.minimum(side.alen, side.blen) >= WIDTH) & ~(side.linked & (side.alen <= WIDTH))
    return np.where(failed, 0, p.m * np.where(side.linked, side.blen, np.minimum(side.alen, side.blen)))


def scores(index: Index, read: np.ndarray, side: Side, p: Params, enough: np.ndarray) -> np.ndarray:
    """Scores of extensions, as ``align.Fill`` has them, a column an extension; ``LOW`` negated where not settled.

    One is settled when the X-drop has closed all its cells, its letters have ended, or it has more than ``enough``.
    Letters beyond an end match nothing, so they add nothing to a score.
    """
    out = np.zeros(len(side.a), np.int64)
    order = np.argsort(np.minimum(side.alen, side.blen))
    for begin in range(0, len(order), PAIRS):
        own = order[begin : begin + PAIRS]
        out[own] = _fill(index, read, *(v[own] for v in (side.a, side.alen, side.b, side.blen)), side.step, p, enough[own])
    return out


def _fill(index, read, a_at, alen, b_at, blen, step, p, enough):
    drop, gi, ge, m = p.xdrop, p.gi, p.ge, p.m
    low, half = np.int32(LOW), np.int32(LOW // 2)
    rows = int(min(ROWS, alen.max(initial=0)))
    y = window(read, b_at, blen, int(min(blen.max(initial=0), reach(rows, p))), step)
    x = window(index.letters, a_at, alen, rows)
    n = len(y)
    top = min(n, max((drop - gi) // ge, 0)) + 1
    h = np.repeat((-gi - ge * np.arange(top, dtype=np.int32))[:, None], len(alen), 1)
    h[0] = 0
    h[h < -drop] = low
    f = np.full_like(h, low)
    best, who, lo = np.zeros(len(alen), np.int32), np.arange(len(alen)), 0
    out = np.zeros(len(alen), np.int64)
    for i in range(rows):
        if lo + len(h) <= n:
            more = np.full((1, h.shape[1]), low, np.int32)
            h, f = np.concatenate([h, more]), np.concatenate([f, more])
        costs = (ge * np.arange(len(h), dtype=np.int32))[:, None]
        f = np.maximum(h - np.int32(gi), f) - np.int32(ge)
        g = f.copy()
        step_up = np.where(y[lo : lo + len(h) - 1] & x[i], np.int32(m), np.int32(-p.x))
        np.maximum(g[1:], h[:-1] + step_up, out=g[1:])
        run = np.maximum.accumulate(g + costs, axis=0)
        np.maximum(g[1:], run[:-1] - np.int32(gi) - costs[1:], out=g[1:])
        bound = np.maximum(best - np.int32(drop), half)
        first = run[-1] - np.int32(gi + ge * len(h))
        more = min(n + 1 - lo - len(h), (int((first - bound).max()) // ge) + 1)
        if more > 0:
            g = np.concatenate([g, first - (ge * np.arange(more, dtype=np.int32))[:, None]])
            f = np.concatenate([f, np.full((more, f.shape[1]), low, np.int32)])
        closed = g < bound
        g[closed] = low
        f[closed] = low
        peak = g.max(axis=0)
        best = np.maximum(best, peak)
        going = (peak > half) & (best <= enough) & (i + 1 < alen)
        if going.sum() < 0.8 * len(going):
            out[who[~going]] = best[~going]
            if not going.any():
                return out
            h, f, best, who, x, y = g[:, going], f[:, going], best[going], who[going], x[:, going], y[:, going]
            enough, alen = enough[going], alen[going]
        else:
            h = g
        alive = np.flatnonzero((h > half).any(axis=1))
        if not len(alive):
            out[who] = best
            return out
        part = slice(int(alive[0]), int(alive[-1]) + 1)
        lo, h, f = lo + part.start, h[part], f[part]
    # unlike one that was settled and is still here, these have cells left
    out[who] = np.where((h > half).any(axis=0) & (alen > rows) & (best <= enough), -LOW, best)
    return out


def screened(index: Index, text: np.ndarray, ends: np.ndarray, at: np.ndarray, row: np.ndarray, p: Params) -> np.ndarray:
    """Which seeds may lead to a result: all but those whose two extensions together do not pass the threshold."""
    own = np.searchsorted(ends, at, "right")
    begin, end = np.append(0, ends)[own], ends[own]
    gid, pos = index.gid[row], index.pos[row]
    routed = np.array([bool(r) for r in index.routes], bool)[index.route[row]]
    size, k = index.size[gid], index.k
    after = np.maximum(size - pos - k, 0)
    fw = Side(index.base[gid] + pos + k, after, at + k, end - at - k, 1, index.linked[gid] | routed)
    rv = Side(index.base[gid ^ 1] + size - pos, pos, at - 1, at - begin, -1, index.linked[gid ^ 1])
    one, two = _UPPER[text], _FLIPPED[text]
    keep = np.arange(len(at))
    a, b = most(index, one, fw, p), most(index, two, rv, p)
    # with routes the forward side begins in another section
    a = np.where(routed, p.m * fw.blen, a)
    keep = keep[a + b > p.score]
    if p.ge and p.xdrop >= 0:
        for letters, side, mine, other in ((one, fw, a, b), (two, rv, b, a)):
            which = keep[(mine[keep] > 0) & ~side.linked[keep]]
            if len(which):
                part = Side(*(getattr(side, v)[which] for v in ("a", "alen", "b", "blen")), side.step, side.linked[which])
                # one that passes with the most of the first side stays, however far it goes on
                enough = p.score - (0 if side is fw else np.minimum(other[which], p.score))
                mine[which] = np.minimum(mine[which], scores(index, letters, part, p, np.broadcast_to(enough, len(which))))
                keep = keep[a[keep] + b[keep] > p.score]
    return keep


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str], np.ndarray, np.ndarray]]:
    """Ids, texts, their letters end to end and where each ends; ``LETTERS`` at once, null texts as empty."""
    ids, texts = batch.column(0), batch.column(1).to_pylist()
    begin = total = 0
    for i in range(len(texts) + 1):
        more = len(texts[i] or "") if i < len(texts) else 0
        if i > begin and (i == len(texts) or total + more > LETTERS):
            own = [t.encode("ascii", "replace") if t else b"" for t in texts[begin:i]]
            yield ids.slice(begin, i - begin), own, np.frombuffer(b"".join(own), np.uint8), np.cumsum([len(t) for t in own])
            begin, total = i, 0
        total += more


SEEDS = "seq string, seeds array<struct<qpos:int,rid:int,rpos:int,route:array<int>>>"
"""Columns of :func:`found` beside ``qid``."""


def found(index: Index, batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """``qid, seq, seeds`` of reads ``(read_ord, seq)`` that have a seed which passes the screen."""
    place = pa.struct([("qpos", pa.int32()), ("rid", pa.int32()), ("rpos", pa.int32()), ("route", pa.list_(pa.int32()))])
    for batch in batches:
        for ids, texts, text, ends in slices(batch):
            at, row = index.seeds(text, ends)
            keep = screened(index, text, ends, at, row, p) if len(at) else at
            at, row = at[keep], row[keep]
            own = np.searchsorted(ends, at, "right")
            reads, first = np.unique(own, return_index=True)
            if not len(reads):
                continue
            lists = pa.StructArray.from_arrays(
                [pa.array(at - np.append(0, ends)[own], pa.int32()), pa.array(index.gid[row], pa.int32()), pa.array(index.pos[row], pa.int32()), pa.array([index.routes[r] for r in index.route[row]], pa.list_(pa.int32()))],
                fields=list(place),
            )
            offsets = pa.array(np.append(first, len(own)), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(reads)), pa.array([texts[r].decode() for r in reads], pa.string()), pa.ListArray.from_arrays(offsets, lists)], ["qid", "seq", "seeds"])
