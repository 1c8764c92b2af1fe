"""Quality rules: counted base rules, and a hashed n-gram log-likelihood ratio.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Base counts of a text: code points in
words, symbol characters, lines equal to an earlier line, and words that lie in
a five-word window found twice or more. A text fails the base rules with fewer
than 10 words, or when over 20 % of its words repeat.

The model compares two multinomials over hashed character n-grams: the trusted
target (labelled rows of quality 1) and the raw corpus (all documents, each
whole). A document's score is the mean log-ratio of its n-grams, so that length
cancels, and it is kept when the score reaches a fixed quantile of the trusted
rows' own scores less a margin; that threshold is the same for all documents.

All rows count: every trusted row fits the target and has its share in the
quantile, which is exact. With no trusted row the base rules alone decide.

Nulls: a null text has no words and fails; null labels are not trusted. Repeated
rows count repeatedly, and equal lines after the first are duplicates.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, filter_texts, map_texts, materialise, slices
from .ngramjoin import only

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
ORDERS = (2, 3)
BUCKETS = 1 << 16
BLOCK = 1 << 10
QUANTILE = 0.001
MARGIN = 0.15
ACCURACY = 100_000  # of the bounds between which the quantile is looked for

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_BLANK = str.maketrans({c: " " for c in "\t\n\v\f\r"})


def words_of(text: str) -> list[str]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` in a text."""
    return [w for w in text.translate(_BLANK).split(" ") if w] if text.isascii() else _WORD.findall(text)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of five words which the text has twice or more."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # dense ids of windows, one word longer each round: exact, no hashing
    window = code
    for k in range(1, REPEAT_WINDOW):
        pair = window[: len(words) - k] * len(ids) + code[k:]
        window = np.unique(pair, return_inverse=True)[1].astype(np.int64) if k < REPEAT_WINDOW - 1 else pair
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    twice = counts[inverse] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[REPEAT_WINDOW : REPEAT_WINDOW + n] -= twice
    return int((edge.cumsum()[:-1] > 0).sum())


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    words = words_of(text)
    lines = [s for s in text.split("\n") if _WORD.search(s)]
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def ngrams(text: str) -> np.ndarray:
    """Bucket of each hashed character n-gram of a text, all orders."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for order in ORDERS:
        n = len(c) - order + 1
        if n > 0:
            h = np.full(n, order, np.uint32)
            for k in range(order):
                h = (h ^ c[k : k + n]) * np.uint32(0x9E3779B1)
            out.append(h >> np.uint32(16))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def target_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of trusted rows: all of quality 1."""
    return labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _blocks(total: np.ndarray) -> pa.RecordBatch:
    """Non-empty buckets and their counts, one row a block of ``BLOCK`` buckets."""
    at = np.flatnonzero(total)
    block, first = np.unique(at // BLOCK, return_index=True)
    ends = pa.array(np.append(first, len(at)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(at, pa.int32()), pa.array(total[at], pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *lists], ["block", "at", "n"])


def counted(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the ``text`` of all rows; a task sends one row a block, and so does each sum to the driver."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                n = np.bincount(ngrams(text))
                total[: len(n)] += n
        yield _blocks(total)

    def add(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            np.add.at(total, b.column("at").flatten().to_numpy(), b.column("n").flatten().to_numpy())
        yield _blocks(total)

    schema = "block int, at array<int>, n array<long>"
    sums = texts.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros(BUCKETS)
    for r in sums.collect():
        out[r["at"]] = r["n"]
    return out


def quantile(scores: DataFrame, share: float) -> float | None:
    """The least ``score`` that at least ``share`` of the rows do not exceed, exactly; None without rows.

    Approximate quantiles to either side bound it; the driver gets the different
    scores between them, a few ``ACCURACY``-ths of the rows.
    """
    width = 2 / ACCURACY
    while True:
        near = F.percentile_approx("score", [max(share - width, 0.0), min(share + width, 1.0)], ACCURACY)
        total, near = scores.agg(F.count("score"), near).first()
        if not total:
            return None
        below = scores.filter(F.col("score") < near[0]).count()
        if below < share * total:
            for score, n in sorted(scores.filter(F.col("score").between(*near)).groupBy("score").count().collect()):
                below += n
                if below >= share * total:
                    return score
        width *= 2  # a bound was off by more than its accuracy


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Log-ratio of each bucket and the threshold; None without a trusted row.

    Only texts of rows that may be trusted are shuffled, once, for the join that
    decides; for the threshold their scores are joined instead. The ids are as many
    as the labels, so they are never broadcast.
    """
    rows, ids = documents(docs), target_ids(labels)
    some, ids = only(rows, ids), ids.hint("merge")
    # not semi-joins, which the optimiser moves before the filter
    raw, target = counted(rows), counted(some.join(ids, "doc_id"))
    if not target.sum():
        return None
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))

    def make():
        return lambda texts: {"score": pa.array([score(t, ratio) for t in texts], pa.float64())}

    own = materialise(map_texts(some, make, "score double").join(ids, "doc_id").select("score"))
    return ratio, quantile(own, QUANTILE) - MARGIN


def score(text: str, ratio: np.ndarray) -> float:
    """Mean log-ratio of a text's n-grams; 0 without any."""
    grams = ngrams(text)
    return float(ratio[grams].mean()) if len(grams) else 0.0


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, ``base_failed``, ``llr`` and ``kept`` for every row of ``docs``."""
    model = fit(docs, labels)

    def make():
        def kernel(texts):
            base = [base_rules(t) for t in texts]
            failed = [fails(b[0], b[4]) for b in base]
            llr = [score(t, model[0]) if model else 0.0 for t in texts]
            kept = [not f and (model is None or s >= model[1]) for f, s in zip(failed, llr)]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            cols = {n: pa.array([b[i] for b in base], pa.int64()) for i, n in enumerate(names)}
            return cols | {"base_failed": pa.array(failed, pa.bool_()), "kept": pa.array(kept, pa.bool_()), "llr": pa.array(llr, pa.float64())}

        return kernel

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    return map_texts(documents(docs), make, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that pass the base rules and the model."""
    model = fit(docs, labels)

    def good(text):
        words = words_of(text or "")
        return not fails(len(words), repeated_words(words)) and (model is None or score(text, model[0]) >= model[1])

    return filter_texts(docs, lambda: lambda texts: [good(t) for t in texts])
