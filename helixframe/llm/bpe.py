"""Byte-level BPE encoding and decoding over a vocabulary of merge ranks.

Text is cut by the vocabulary's split pattern and each piece is merged on its
own. A piece's adjacent pairs wait in buckets, one for each merge rank; a bucket
holds places in the piece's linked list. A bitmap of three levels of 64-bit
words marks the buckets in use: find-first-set in the top word, then in the one
below, gives the least rank in constant time. A merge takes the bucket's places
from left to right, skips stale ones (whose pair has changed since), links the
symbols and files the two new pairs. Pieces of any length cost a constant number
of queue steps a merge.

Ids of pieces met before are looked up in a table of bounded size.

Split patterns are read with the letters, numbers and blanks of the Unicode
version that the tiktoken library has, whatever version ``regex`` has: where the
two differ, a stand-in of the same kind takes the character's place while pieces
are cut. (Classes other than ``\\p{L}``, ``\\p{N}`` and ``\\s`` are left to ``regex``.)

Nulls: a null text is an empty one, with no ids. Texts may be of any length, an
empty table gives no rows. Repeated rows give repeated result rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import documents, map_texts
from .tokens import Recent

CACHE = 500_000  # pieces in each of two generations
PAIRS = 1_000_000


#: a character of each kind for a split pattern, and one of none of them
STAND_IN = {r"\p{L}": "z", r"\p{N}": "0", r"\s": "\t"}
NO_KIND = "!"


@lru_cache(1)
def newer_characters() -> dict[int, str]:
    """Code points that ``regex`` and the tiktoken library put in different kinds, with a stand-in of the library's kind."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    odd, kinds = set(), {}
    for kind, stand_in in STAND_IN.items():
        # with a pattern that is one class, the library's ids are the bytes of the class's characters
        library = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(library.encode_ordinary(every)).decode())
        odd |= theirs ^ set(regex.findall(kind, every))
        kinds |= dict.fromkeys(theirs, stand_in)
    return {ord(c): kinds.get(c, NO_KIND) for c in odd}


def finder(points: Iterable[int]) -> Callable[[str], object]:
    """Whether a text has one of these code points, by a class of ranges; texts below the least of them are told at once."""
    runs: list[list[int]] = []
    for c in sorted(points):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    if not runs:
        return lambda text: None
    spell = lambda a, b: rf"\U{a:08x}-\U{b:08x}"
    beyond = re.compile(f"[{spell(runs[0][0], 0x10FFFF)}]").search
    one_of = re.compile("[" + "".join(spell(a, b) for a, b in runs) + "]").search

    def find(text: str) -> object:
        first = beyond(text)
        return first and one_of(text, first.start())

    return find


class RankQueue:
    """Buckets by merge rank under a three-level bitmap; up to 64**3 ranks."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, ranks: int) -> None:
        if ranks > 1 << 18:
            raise ValueError("the bitmap has room for 262144 ranks")
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(place)
            return
        self.buckets[rank] = [place]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]]:
        """Least rank in use and its places; the bucket is then empty."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        bit = word & -word
        rank = b << 6 | bit.bit_length() - 1
        self.low[b] = word = word ^ bit
        if not word:
            self.mid[a] = word = self.mid[a] ^ (1 << (b & 63))
            if not word:
                self.top ^= 1 << a
        return rank, self.buckets.pop(rank)


class Codec:
    """Encoder and decoder for a rank file (base64 token and rank on each line) and a split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.size = max(self.ranks.values()) + 1
        self.split = regex.compile(pattern)
        self.newer = newer_characters()
        self.has_newer = finder(self.newer)
        self.bytes_id = [self.ranks[bytes([b])] for b in range(256)]
        self.queue = RankQueue(self.size)
        self.known = Recent(CACHE, self._packed)
        tokens = [b""] * self.size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.tokens = tokens
        # pair of ids -> id of their concatenation, filled as pairs are met
        self.pairs: dict[int, int] = {}

    def _joined(self, a: int, b: int) -> int:
        """Rank of two adjacent symbols as one, or -1; remembered."""
        r = self.pairs[a * self.size + b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        known, slow, size, queue = self.pairs.get, self._joined, self.size, self.queue
        push, pop = queue.push, queue.pop
        ids = self.bytes_id
        sym = [ids[b] for b in piece]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        i = 0
        for a, b in zip(sym, sym[1:]):
            r = known(a * size + b)
            if r is None:
                r = slow(a, b)
            if r >= 0:
                push(r, i)
            i += 1
        while queue.top:
            rank, places = pop()
            if len(places) > 1:
                places.sort()
            for i in places:
                j = after[i]
                a = sym[i]
                if a < 0 or j >= n or known(a * size + sym[j]) != rank:
                    continue  # stale
                sym[i], sym[j] = rank, -1
                j = after[i] = after[j]
                if j < n:
                    before[j] = i
                    b = sym[j]
                    r = known(rank * size + b)
                    if r is None:
                        r = slow(rank, b)
                    if r >= 0:
                        push(r, i)
                h = before[i]
                if h >= 0:
                    b = sym[h]
                    r = known(b * size + rank)
                    if r is None:
                        r = slow(b, rank)
                    if r >= 0:
                        push(r, h)
        return [s for s in sym if s >= 0]

    def _packed(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece.encode()))
        return np.frombuffer(ids, np.uint32).astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()  # between texts only: a queue in use relies on them
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def pieces(self, text: str) -> list[str]:
        """The matches of the split pattern."""
        if text.isascii() or not self.has_newer(text):
            return self.split.findall(text)
        return [text[slice(*m.span())] for m in self.split.finditer(text.translate(self.newer))]

    def decode(self, packed: bytes) -> bytes:
        """Bytes of ids packed by :meth:`encode`."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, same`` for every row of ``docs``.

    ``same`` tells whether the decoded bytes are the text's.
    """

    def make():
        c = codec(path, pattern)

        def kernel(texts):
            n, ids, back, same = [], [], [], []
            for t in texts:
                packed = c.encode(t)
                out = c.decode(packed)
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(out).hexdigest())
                same.append(out == t.encode())
            return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(back), "same": pa.array(same)}

        return kernel

    return map_texts(documents(docs), make, "n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
