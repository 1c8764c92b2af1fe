"""Packing of documents into windows of fixed length by the sum-of-squares rule.

A document's ids (and an end id) are cut into full windows and a rest. Each rest
goes, online, to the fill level that makes the sum of squared counts of partly
filled windows least: with ``N[h]`` windows open at fill ``h``, a rest of length
``s`` joins a window at ``h`` for a change of ``N[h+s] - N[h] + 1`` (or
``1/2 - N[h]`` where it fills the window), or opens one for ``N[s] + 1/2``. The
counts stand in one level array; ties go to the fuller window, and a new one
last.

Each task packs the rows of its own partition, so nothing is shuffled. At its end
the windows still open are settled: the fullest are topped up with pieces cut
from the emptiest, and the one that stays partly filled is cut into sequences of
a power of two, which need no padding. Where more than ``MAX_OPEN`` windows are
open at once they are settled early, which bounds memory.

Nulls: a null text is an empty one, whose only id is the end id; a null doc_id is
carried. Repeated rows are packed repeatedly. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents, slices
from .tokens import encoder

WINDOW = 4096
END = 2
MAX_OPEN = 2048


class Piece:
    """Part of a document: its row, its first id there, and its ids as packed bytes."""

    __slots__ = ("row", "start", "ids")

    def __init__(self, row: tuple, start: int, ids: bytes) -> None:
        self.row, self.start, self.ids = row, start, ids

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.start, self.ids[: 4 * n]), Piece(self.row, self.start + n, self.ids[4 * n :])


class Packer:
    """Sum-of-squares packer; :meth:`add` and :meth:`settle` return sequences (lists of pieces) as they close."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN) -> None:
        self.window, self.max_open = window, max_open
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.count = 0

    def place(self, size: int) -> int:
        """The fill level for a rest of ``size`` ids; 0 opens a window."""
        n, w = self.level, self.window
        if not self.count:
            return 0
        have = n[1 : w - size + 1]  # levels 1 .. window - size
        cost = n[1 + size : w + 1] - have + 1.0
        cost[-1] = 0.5 - have[-1]
        cost[have == 0] = np.inf
        best = len(cost) - 1 - int(cost[::-1].argmin())
        return best + 1 if cost[best] <= n[size] + 0.5 else 0

    def add(self, row: tuple, ids: bytes) -> list[list[Piece]]:
        out, w = [], self.window
        n = len(ids) // 4
        full = n - n % w
        for lo in range(0, full, w):
            out.append([Piece(row, lo, ids[4 * lo : 4 * (lo + w)])])
        size = n - full
        if not size:
            return out
        at = self.place(size)
        if at:
            pieces = self.open[at].pop()
            self.level[at] -= 1
            self.count -= 1
        else:
            pieces = []
        pieces.append(Piece(row, full, ids[4 * full :]))
        if at + size == w:
            out.append(pieces)
        else:
            self.open[at + size].append(pieces)
            self.level[at + size] += 1
            self.count += 1
            if self.count > self.max_open:
                out += self.settle(last=False)
        return out

    def settle(self, last: bool = True) -> list[list[Piece]]:
        """Close all windows; at most one stays partly filled, which the last call cuts into powers of two."""
        rest = [(h, pieces) for h in range(self.window - 1, 0, -1) for pieces in self.open[h]]
        self.open = [[] for _ in range(self.window)]
        self.level[:] = 0
        self.count = 0
        out, lo, hi = [], 0, len(rest) - 1
        while lo < hi:
            fill, pieces = rest[lo]
            have, donor = rest[hi]
            need = self.window - fill
            while need and donor:
                piece = donor.pop()
                if len(piece) > need:
                    piece, back = piece.cut(need)
                    donor.append(back)
                pieces.append(piece)
                need -= len(piece)
                have -= len(piece)
            rest[lo], rest[hi] = (self.window - need, pieces), (have, donor)
            if not donor:
                hi -= 1
            if not need:
                out.append(pieces)
                lo += 1
        if lo == hi and rest[lo][0] == self.window:
            out.append(rest[lo][1])
        elif lo == hi and rest[lo][0]:
            fill, pieces = rest[lo]
            if last:
                out += powers(fill, pieces)
            else:
                self.open[fill].append(pieces)
                self.level[fill] = self.count = 1
        return out


def powers(fill: int, pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces as sequences whose lengths are the powers of two in ``fill``."""
    out, todo = [], pieces[::-1]
    for bit in range(fill.bit_length() - 1, -1, -1):
        need, own = fill & 1 << bit, []
        while need:
            piece = todo.pop()
            if len(piece) > need:
                piece, back = piece.cut(need)
                todo.append(back)
            own.append(piece)
            need -= len(piece)
        if own:
            out.append(own)
    return out


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, ids: bool = True) -> DataFrame:
    """A row for each piece: where it comes from, where it goes, the crc32 of its ids, and (``ids``) the ids.

    ``path`` is a tokenizer file that drops white space. ``sequence_id`` is the
    task's partition and a counter within it.
    """
    def run(batches):
        enc, packer = encoder(path, False), Packer(window)
        base = TaskContext.get().partitionId() << 32
        made = 0

        def rows(sequences):
            nonlocal made
            cols = [[] for _ in range(8)]
            for pieces in sequences:
                at = 0
                for p in pieces:
                    for c, v in zip(cols, (p.row[0], p.start, len(p), p.row[1], base | made, at, zlib.crc32(p.ids), p.ids)):
                        c.append(v)
                    at += len(p)
                made += 1
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = {n: pa.array(c, pa.int64()) for n, c in zip(names, cols)}
            if ids:
                out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[7]], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(out)

        for b in slices(batches):
            done = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packed = np.append(np.frombuffer(enc.one(text), enc.kind).astype("<u4"), np.uint32(end)).astype("<u4").tobytes()
                done += packer.add((doc_id, len(packed) // 4), packed)
            yield rows(done)
        yield rows(packer.settle())

    return documents(docs).mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))
