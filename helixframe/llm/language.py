"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1/-1. A trigram ``abc`` is bound as
``p(p(A)) * p(B) * C`` (``p`` rotates by one place), a text bundles (sums) its
trigram vectors, and a language's prototype bundles all texts of that language
in the training folds. A document gets the language of the prototype with the
highest cosine; ``score`` is that cosine, clipped to 0..1.

Trigrams run over lower-cased letters, with one blank between words; letters
are taken modulo ``LETTERS`` classes, so every script is covered in fixed space.
All training documents are counted, each with its whole text.

:func:`keep_identified` rejects what no learned language resembles. How high a
cosine is to be expected depends on a text's length, so the training rows give a
threshold for each class of length (doublings of code points): the ``QUANTILE`` of
the cosines of those whose language was told rightly, times ``MARGIN``.

Nulls: a null text, or one without letters, gives ``und`` with score 0; null
languages are not learned. Without any training text all is ``und``. Ties go to
the language first in alphabetical order. Repeated rows count repeatedly, and each
gives its result row. An empty table gives no rows. Long texts are bundled whole;
a null doc_id is a training row.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, documents, filter_texts, map_texts, slices

DIM = 1024
LETTERS = 64  # class 0 is the blank between words
SEED = 20_011
FOLDS, HELD_OUT = 3, 1
QUANTILE, MARGIN = 0.001, 0.9
_CHARS = 400_000  # of a block of texts that is counted at once


class Letters:
    """Class of each code point: 0 for what is no letter, else 1 to ``LETTERS - 1``."""

    def __init__(self) -> None:
        alpha = np.frombuffer(bytes(chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.uint8)
        self.table = np.where(alpha, 1 + np.arange(len(alpha)) % (LETTERS - 1), 0).astype(np.uint8)
        self.vectors = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, DIM))
        self._rolled = [np.roll(self.vectors, k, axis=1) for k in (2, 1, 0)]

    def trigrams(self, text: str) -> np.ndarray:
        """Codes of the trigrams of a text; empty where it has no letter."""
        classes = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        padded = np.zeros(len(classes) + 2, np.int32)
        padded[1:-1] = classes
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] > 0) | (padded[:-1] > 0)
        c = padded[keep]
        if len(c) < 3:
            return c[:0]
        return (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigram codes, as float32 rows."""
        a, b, c = codes // LETTERS**2, codes // LETTERS % LETTERS, codes % LETTERS
        return (self._rolled[0][a] * self._rolled[1][b] * self._rolled[2][c]).astype(np.float32)

    def bundles(self, texts: list[str]):
        """Yields ``(row numbers, bundled vectors)`` for blocks of the texts that have letters."""
        block, rows, size = [], [], 0
        for i, t in enumerate(texts):
            codes = self.trigrams(t) if t else None
            if codes is not None and len(codes):
                block.append(codes)
                rows.append(i)
                size += len(codes)
                if size >= _CHARS or len(rows) >= 256:
                    yield rows, self._bundle(block)
                    block, rows, size = [], [], 0
        if rows:
            yield rows, self._bundle(block)

    def _bundle(self, block: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(block)
        used = np.flatnonzero(np.bincount(flat, minlength=LETTERS**3))
        place = np.zeros(LETTERS**3, np.int64)
        place[used] = np.arange(len(used))
        owner = np.repeat(np.arange(len(block)), [len(b) for b in block])
        out = np.zeros((len(block), DIM), np.float32)
        for lo in range(0, len(used), 4096):  # bounded memory on any alphabet
            part = used[lo : lo + 4096]
            at = place[flat] - lo
            sel = (at >= 0) & (at < len(part))
            counts = np.bincount(owner[sel] * len(part) + at[sel], minlength=len(block) * len(part))
            out += counts.reshape(len(block), len(part)).astype(np.float32) @ self.bound(part)
        return out


@lru_cache(1)
def known_letters() -> Letters:
    """One table for all tasks of a worker."""
    return Letters()


def prototypes(docs: DataFrame, lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes of the languages of ``docs``, which should be training rows.

    Tasks bundle their rows by language and send one vector each; the driver gets
    ``DIM`` sums a language.
    """
    rows = docs.select(F.col(lang).alias("lang"), "text").filter("lang is not null and text is not null")

    def run(batches):
        letters, sums = known_letters(), {}
        for b in slices(batches):
            langs = b.column(0).to_pylist()
            for at, vectors in letters.bundles(b.column(1).to_pylist()):
                for name in {langs[i] for i in at}:
                    mine = vectors[[langs[i] == name for i in at]].sum(0, dtype=np.float64)
                    sums[name] = sums.get(name, 0) + mine
        for name, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * DIM, "dim": pa.array(range(DIM), pa.int32()), "v": pa.array(v.astype(np.int64), pa.int64())})

    sums: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(run, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r["lang"], np.zeros(DIM))[r["dim"]] = r["v"]
    names = sorted(sums)
    protos = np.array([sums[n] for n in names]).reshape(len(names), DIM)
    return names, protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)


def _predictor(names: list[str], protos: np.ndarray):
    def make():
        letters, weights = known_letters(), protos.T.astype(np.float32)

        def predict(texts):
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if names:
                for at, vectors in letters.bundles(texts):
                    cos = (vectors @ weights).astype(np.float64) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                    best = cos.argmax(1)
                    for i, j, c in zip(at, best, cos):
                        lang[i], score[i] = names[j], float(min(max(c[j], 0.0), 1.0))
            return lang, score

        return predict

    return make


def _learned(docs: DataFrame):
    return _predictor(*prototypes(_training(docs)))


def _training(docs: DataFrame) -> DataFrame:
    return docs.filter(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def thresholds(docs: DataFrame, make_predictor, lang: str = "lang") -> list[float]:
    """Least cosine by class of length (``bit_length`` of a text's code points), from training rows ``docs``.

    The driver gets one number for each class. A class without rows takes that of the next shorter one.
    """
    rows = docs.select(F.col(lang).alias("lang"), "text").filter("lang is not null and text is not null")

    def run(batches):
        predict = make_predictor()
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            found = [(len(t).bit_length(), s) for t, own, g, s in zip(texts, b.column(0).to_pylist(), *predict(texts)) if g == own]
            yield pa.RecordBatch.from_pydict({"size": pa.array([x for x, _ in found], pa.int32()), "score": pa.array([x for _, x in found], pa.float64())})

    known = {r["size"]: r["least"] * MARGIN for r in rows.mapInArrow(run, "size int, score double").groupBy("size").agg(F.percentile_approx("score", QUANTILE, 10_000).alias("least")).collect()}
    out = [0.0]
    for size in range(1, 65):
        out.append(known.get(size, out[-1]))
    return out


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``)."""
    make_predictor = _learned(docs)

    def make():
        predict = make_predictor()

        def kernel(texts):
            lang, score = predict(texts)
            return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

        return kernel

    out = map_texts(documents(docs), make, "lang_pred string, score double")
    return out.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language with the cosine that texts of its length reach (:func:`thresholds`)."""
    make_predictor = _learned(docs)
    least = thresholds(_training(docs), make_predictor)

    def make():
        predict = make_predictor()
        return lambda texts: [g != "und" and s >= least[len(t).bit_length()] for t, g, s in zip(texts, *predict(texts))]

    return filter_texts(docs, make)
