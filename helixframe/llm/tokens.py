"""Token ids through the tokenizers library, piece by piece.

A text is cut where the tokenizer's own split pattern cuts, each different piece
is merged once by the library's model, and its ids are kept in a table of bounded
size. The cut here is written for characters below U+0250 less a few; a text with
any other character goes to the library whole.

:meth:`Encoder.packed` does the same for an Arrow array of texts: numpy cuts the
bytes of all of them at once, Arrow tells the different pieces apart, and only
those are looked up one by one.
"""

from __future__ import annotations

import os
import re
import string
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

CACHE = 500_000  # pieces in each of two generations
FEW = 150_000  # of vocabularies without blanks and cases, whose pieces are fewer
_BIG = sys.byteorder == "big"
LONG = 256  # characters of a piece that is not kept in the table

# Characters that Python's classes and the library's tell apart, or that normalisation may change.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbe\u0130\u0250-\U0010ffff]")
# Fixed: the split patterns of the two kinds of vocabulary, for the characters that are left; words first, which no
# other part can begin, and letters as ranges, which match faster than classes.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_WITH_BLANKS = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+")
_NO_BLANKS = re.compile(rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_L}]+")

# The same classes for bytes of UTF-8. The lead byte of U+0080-U+00BF, and second bytes that some lead byte makes no
# letter, are told apart by the byte beside them.
_BLANK, _SPACE, _LETTER, _DIGIT, _OTHER, _STRANGE, _LEAD_C2, _SECOND = range(8)


def _byte_classes() -> bytes:
    """The class of each byte, for ``bytes.translate``."""
    out = bytearray([_OTHER]) * 0x80 + bytearray([_LETTER]) * 0x49 + bytearray([_STRANGE]) * 0x37
    for kind, own in ((_LETTER, string.ascii_letters), (_DIGIT, string.digits), (_SPACE, "\t\n\r"), (_STRANGE, "\x0b\x0c\x1c\x1d\x1e\x1f")):
        for b in own.encode():
            out[b] = kind
    for b in (0x97, 0xB0, 0xB7):
        out[b] = _SECOND
    out[0x20], out[0xC2] = _BLANK, _LEAD_C2
    return bytes(out)


_CLASSES = _byte_classes()


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character; ``_STRANGE`` somewhere in a character that the cut is not written for."""
    kind = np.frombuffer(bytearray(data.tobytes().translate(_CLASSES)), np.uint8)
    at = np.flatnonzero(kind == _SECOND)
    if len(at):
        kind[at] = _LETTER
        lead, second = data[at - 1], data[at]
        signs = at[(lead == 0xC3) & (second != 0xB0)]  # multiplication and division
        kind[signs] = kind[signs - 1] = _OTHER
        kind[at[(lead == 0xC4) & (second == 0xB0)]] = _STRANGE
    at = np.flatnonzero(kind == _LEAD_C2)
    if len(at):
        second = data[at + 1]
        kind[at] = kind[at + 1] = np.where(np.isin(second, (0xAA, 0xB5, 0xBA)), _LETTER, _OTHER)
        kind[at[np.isin(second, (0x85, 0xA0, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE))]] = _STRANGE
    return kind


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts begin that lie end to end, as ``_WITH_BLANKS`` cuts them; and the rows left whole for a strange character."""
    kind = _classes(data)
    begins, ends = offsets[:-1], offsets[1:]
    white = kind <= _SPACE
    # A piece begins where the class changes, but not behind the one blank that goes with it; of a run of white space
    # the last character, where more text follows.
    start = np.empty(len(data), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[1:] &= kind[:-1] != _BLANK
    start[1:] &= ~(white[1:] & white[:-1])
    start[1:] |= white[1:] & ~white[:-1]
    start[1:-1] |= white[1:-1] & white[:-2] & ~white[2:]
    last = ends[ends - begins > 1] - 1
    start[last] &= ~(white[last] & white[last - 1])
    start[begins[begins < ends]] = True
    # 's 't 'm 'd 're 've 'll behind no blank: what follows is a piece of its own.
    mark = np.flatnonzero(data == 0x27)
    mark = mark[start[mark]]
    if len(mark):
        end = ends[np.searchsorted(ends, mark, "right")]
        one, two = (data[np.minimum(mark + k, len(data) - 1)] for k in (1, 2))
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where((np.isin(one, list(b"rv")) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)), 3, 0))
        own = (size > 0) & (mark + size <= end)
        mark, size, end = mark[own], size[own], end[own]
        start[mark + 1] = False
        after = mark + size
        start[after[after < end]] = True
    whole = np.unique(np.searchsorted(ends, np.flatnonzero(kind == _STRANGE), "right"))
    for r in whole.tolist():
        start[begins[r] + 1 : ends[r]] = False
    return np.flatnonzero(start), whole


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Recent(dict):
    """A table of bounded size that makes what it lacks, in two generations.

    What is used again moves to the new generation, and the old one goes when that
    is full.
    """

    def __init__(self, size: int, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.size, self.make = size, make
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of texts as packed little-endian unsigned integers of type ``kind``: two bytes where the vocabulary fits.

    ``blanks`` tells whether the vocabulary encodes white space (a piece being a
    word with the one blank before it) or drops it and puts letters into lower
    case. The strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, blanks: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.letters = _byte_letters()
        self.blanks = blanks
        self.known = Recent(CACHE if blanks else FEW, self._merged)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _merged(self, piece: str) -> bytes:
        """Ids of one piece, by the library's model."""
        out = array("H" if self.kind == "<u2" else "I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        if _BIG:
            out.byteswap()
        return out.tobytes()

    def one(self, text: str) -> bytes:
        """Ids of a text."""
        if _ODD.search(text):
            return self._whole(text)
        pieces = _WITH_BLANKS.findall(text) if self.blanks else _NO_BLANKS.findall(text.lower())
        return b"".join(map(self.known.__getitem__, pieces))

    def packed(self, texts: pa.Array, tail: bytes = b"") -> pa.Array:
        """Ids of each text and ``tail``, as :meth:`one` has them, for a vocabulary with blanks and texts without nulls."""
        texts = texts.cast(pa.string())
        if texts.offset:
            texts = pa.concat_arrays([texts])  # its own offsets
        n = len(texts)
        _, where, letters = texts.buffers()
        offsets = np.frombuffer(where, np.int32, n + 1) if n else np.zeros(1, np.int32)
        first, last = int(offsets[0]), int(offsets[-1])
        if first == last:
            return pa.array([tail] * n, pa.binary())
        at, whole = _cut(np.frombuffer(letters, np.uint8, last)[first:], (offsets - first).astype(np.int64))
        begins = np.append(at + first, last).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(begins), letters).dictionary_encode()
        codes, different = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds = np.searchsorted(at, offsets - first)
        strange = {}
        for k in np.unique(codes[bounds[whole]]).tolist():
            strange[k], different[k] = self.one(different[k]), ""
        values = list(map(self.known.__getitem__, different))
        for k, ids in strange.items():
            values[k] = ids
        codes = np.insert(codes, bounds[1:], len(values))
        values.append(tail)
        ids = pa.array(values, pa.binary()).take(pa.array(codes))
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        ends = np.frombuffer(ids.buffers()[1], np.int32)[bounds + np.arange(n + 1)]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), ids.buffers()[2]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return [self.one(t) for t in texts]


@lru_cache(2)
def encoder(path: str, blanks: bool) -> Encoder:
    return Encoder(path, blanks)
