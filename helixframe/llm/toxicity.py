"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of ``\\w`` in lower case; a run of more than ``LONG`` characters (a
text without blanks) is read as pieces of that length, each half over the one
before, so every character counts. A word's input is its own hashed embedding
beside the mean embedding of its hashed character trigrams. A text is cut into
overlapping windows of ``WINDOW`` words, one every ``STRIDE``; the network reads each
window both ways, pools its states by attention, and the text's score is the
highest of all its windows. All windows of the whole text are scored.

Training takes a bounded, documented sample of labelled rows outside the held-out
fold: ``POSITIVE_ROWS`` toxic and ``NEGATIVE_ROWS`` other rows at most, in the order of
their ids' hash, as long as the texts of one label have ``POSITIVE_CHARS`` or
``NEGATIVE_CHARS`` characters or fewer together; texts of any length, each whole. The first epochs give each window
its text's label (a fresh random ``EPOCH_WINDOWS`` of them an epoch); later ones learn
from the highest window of each text alone, as a text is toxic when one window is.
At the end the bias is set so that 0.5 parts the sample's own scores best, a false
alarm weighing three times a miss.

Nulls: a null text is an empty one; it scores as a window without words does.
Null labels are not learned from. Without rows of both labels all texts score 0,
and an empty table gives no rows. Repeated rows give repeated result rows; of
several labels for one id the highest counts, of several texts the least. Of
windows that score alike the first is learned from.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, documents, map_texts

WINDOW, STRIDE = 32, 16
ROWS = 1 << 13  # of each embedding table
EMBED, HIDDEN = 12, 8
FOLDS, HELD_OUT = 5, 0
POSITIVE_ROWS, NEGATIVE_ROWS = 1200, 2400
POSITIVE_CHARS, NEGATIVE_CHARS = 1_500_000, 6_500_000
EPOCH_WINDOWS = 30_000
LONG = 64
KNOWN = 150_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    if max(map(len, words), default=0) <= LONG:
        return words
    half = LONG // 2
    return [w[i : i + LONG] for w in words for i in range(0, max(len(w) - half, 1), half)]


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word row of each word, and the rows of its character trigrams with where each word's begin."""
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    h = np.full(len(chars), 7, np.uint32)
    for k in range(3):
        h[: len(chars) - k] = (h[: len(chars) - k] ^ chars[k:]) * np.uint32(0x9E3779B1)
    inside = np.ones(len(chars), bool)
    inside[ends - 1] = inside[ends - 2] = False
    place = np.arange(len(chars)) - np.repeat(begins, lengths)
    mixed = (h ^ (place.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    mixed[~inside] = 0
    word = (np.add.reduceat(mixed, begins, dtype=np.uint32) * np.uint32(0x27D4EB2F)) >> np.uint32(19)
    counts = lengths - 2
    return word.astype(np.int64), (h[inside] >> np.uint32(19)).astype(np.int64), np.cumsum(counts) - counts


class Network:
    """Parameters and their use; ``p`` maps names to arrays."""

    def __init__(self, p: dict[str, np.ndarray] | None = None, seed: int = 17) -> None:
        if p is None:
            g = np.random.default_rng(seed)
            e, h = 2 * EMBED, HIDDEN

            def draw(*shape, scale):
                return (g.standard_normal(shape) * scale).astype(np.float32)

            p = {
                "word": draw(ROWS, EMBED, scale=0.1),
                "char": draw(ROWS, EMBED, scale=0.3),
                "wx": draw(2, e, 3 * h, scale=e**-0.5),
                "bx": np.zeros((2, 1, 3 * h), np.float32),
                "wh": draw(2, h, 3 * h, scale=h**-0.5),
                "wa": draw(2 * h, 2 * h, scale=(2 * h) ** -0.5),
                "ba": np.zeros(2 * h, np.float32),
                "va": draw(2 * h, scale=0.3),
                "wo": draw(2 * h, scale=0.3),
                "bo": np.zeros(1, np.float32),
            }
        self.p = p

    def inputs(self, words: list[str]):
        """Input vectors of words, with what :meth:`learn` needs."""
        w, c, at = hashed(words)
        n = np.diff(np.append(at, len(c))).astype(np.float32)[:, None]
        x = np.concatenate([self.p["word"][w], np.add.reduceat(self.p["char"][c], at, axis=0) / n], axis=1)
        return x, (w, c, at, n)

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows: ``index`` has rows of ``gates`` (2, words, 3H), -1 for places past a window's end."""
        p, h = self.p, HIDDEN
        n, steps = index.shape
        mask = index >= 0
        state = np.zeros((2, n, h), np.float32)
        states = np.zeros((steps, 2, n, h), np.float32)
        saved = []
        for t in range(steps):
            own, back = index[:, t], index[:, steps - 1 - t]
            g = np.stack([gates[0][own], gates[1][back]])
            u = np.matmul(state, p["wh"])
            zr = np.tanh((g[..., : 2 * h] + u[..., : 2 * h]) * np.float32(0.5))
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(g[..., 2 * h :] + r * u[..., 2 * h :])
            m = np.stack([mask[:, t], mask[:, steps - 1 - t]])[..., None]
            new = np.where(m, c + z * (state - c), state)
            if keep:
                saved.append((state, u, z, r, c, m))
            state = new
            states[t, 0], states[steps - 1 - t, 1] = new[0], new[1]
        out = states.transpose(2, 0, 1, 3).reshape(n, steps, 2 * h)
        act = np.tanh(out @ p["wa"] + p["ba"])
        e = np.where(mask, act @ p["va"], np.float32(-1e9))
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        a *= mask
        pooled = np.einsum("nt,nth->nh", a, out)
        logit = pooled @ p["wo"] + p["bo"][0]
        return logit, (out, act, a, pooled, mask, saved) if keep else None

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.matmul(x[None], self.p["wx"]) + self.p["bx"]

    def learn(self, words: list[str], index: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss of windows over ``words``."""
        p, h = self.p, HIDDEN
        x, (w, c, at, count) = self.inputs(words)
        gates = self.gates(x)
        logit, (out, act, a, pooled, mask, saved) = self.forward(gates, index, keep=True)
        n, steps = index.shape
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / n).astype(np.float32)
        grad = {"wo": pooled.T @ d, "bo": d.sum(keepdims=True)}
        dpool = d[:, None] * p["wo"]
        da = np.einsum("nh,nth->nt", dpool, out)
        dout = a[..., None] * dpool[:, None]
        de = a * (da - (a * da).sum(1, keepdims=True))
        grad["va"] = np.einsum("nt,nth->h", de, act)
        dact = de[..., None] * p["va"] * (1 - act**2)
        grad["wa"] = np.einsum("nti,ntj->ij", out, dact)
        grad["ba"] = dact.sum((0, 1))
        dout += dact @ p["wa"].T
        dstates = dout.reshape(n, steps, 2, h)
        dplaces, dwh = np.zeros((2, n, steps, 3 * h), gates.dtype), np.zeros_like(p["wh"])
        dnext = np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, u, z, r, cand, m = saved[t]
            dh = dnext + np.stack([dstates[:, t, 0], dstates[:, steps - 1 - t, 1]])
            dm = np.where(m, dh, 0)
            dz = dm * (state - cand) * z * (1 - z)
            dc = dm * (1 - z) * (1 - cand**2)
            dr = dc * u[..., 2 * h :] * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], axis=-1)
            du = np.concatenate([dz, dr, dc * r], axis=-1)
            dwh += np.matmul(state.transpose(0, 2, 1), du)
            dnext = np.where(m, dm * z, dh) + np.matmul(du, p["wh"].transpose(0, 2, 1))
            dplaces[0, :, t], dplaces[1, :, steps - 1 - t] = dg
        dgates = np.stack([_sums(index[mask], dplaces[k][mask], gates.shape[1]) for k in (0, 1)])
        grad["wh"], grad["bx"] = dwh, dgates.sum(1, keepdims=True)
        grad["wx"] = np.matmul(x.T[None], dgates)
        dx = np.matmul(dgates, p["wx"].transpose(0, 2, 1)).sum(0)
        grad["word"] = _sums(w, dx[:, :EMBED], ROWS)
        grad["char"] = _sums(c, np.repeat(dx[:, EMBED:] / count, count[:, 0].astype(np.int64), axis=0), ROWS)
        return grad


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows: the sums of ``rows`` by their place."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        own, begins = np.unique(at[order], return_index=True)
        out[own] = np.add.reduceat(rows[order], begins, axis=0)
    return out


def window_index(n: int) -> np.ndarray:
    """Word numbers of the overlapping windows of a text of ``n`` words, -1 past its end."""
    starts = np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE)
    index = starts[:, None] + np.arange(WINDOW)
    return np.where(index < n, index, -1)


class Scorer:
    """Scores texts, keeping the inputs of words met before in a table of bounded size."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.net = Network(p)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.gates = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self._clear()
        known, first = self.known, len(self.known)
        rows = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        if len(known) > first:
            if len(known) > self.gates.shape[1]:
                more = np.zeros((2, max(len(known), 2 * self.gates.shape[1]), 3 * HIDDEN), np.float32)
                more[:, :first] = self.gates[:, :first]
                self.gates = more
            fresh = list(known)[first:] if len(known) - first > 50_000 else _tail(known, len(known) - first)
            for lo in range(0, len(fresh), 8192):
                part = fresh[lo : lo + 8192]
                self.gates[:, first + lo : first + lo + len(part)] = self.net.gates(self.net.inputs(part)[0])
        return rows

    def logits(self, texts: list[str]) -> list[np.ndarray]:
        """Logits of all windows of each text."""
        out, block, owners, held = [[] for _ in texts], [], [], 0

        def flush():
            if block:
                logit = self.net.forward(self.gates, np.concatenate(block))[0]
                at = 0
                for i, b in zip(owners, block):
                    out[i].append(logit[at : at + len(b)])
                    at += len(b)
                block.clear()
                owners.clear()

        for i, t in enumerate(texts):
            words = words_of(t)
            if len(self.known) > KNOWN:
                flush()
                held = 0
            rows = np.append(self._rows(words), -1)
            index = window_index(len(words))
            index = rows[index]
            for lo in range(0, len(index), 2048):
                part = index[lo : lo + 2048]
                if held + len(part) > 2048:
                    flush()
                    held = 0
                block.append(part)
                owners.append(i)
                held += len(part)
        flush()
        return [np.concatenate(x) for x in out]

    def scores(self, texts: list[str]) -> np.ndarray:
        top = np.array([x.max() for x in self.logits(texts)], np.float64)
        return 1 / (1 + np.exp(-np.clip(top, -40, 40)))


def _tail(known: dict[str, int], n: int) -> list[str]:
    """The last ``n`` keys, in order."""
    it = reversed(known)
    return [next(it) for _ in range(n)][::-1]


def train(texts: list[str], labels: list[int], seed: int = 5, epochs: tuple[int, int] = (4, 6), rate: float = 0.01) -> dict[str, np.ndarray] | None:
    """Parameters fitted to labelled texts; None unless both labels occur."""
    if len(set(labels)) < 2:
        return None
    net = Network()
    g = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    vocabulary: dict[str, int] = {}
    split = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    names = list(vocabulary)
    windows = [np.append(own, -1)[window_index(len(own))] for own in split]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def fit(chosen: list[tuple[int, int]]) -> None:
        nonlocal step
        for lo in range(0, len(chosen), 256):
            part = chosen[lo : lo + 256]
            index = np.array([windows[i][j] for i, j in part])
            used, place = np.unique(index, return_inverse=True)
            first = int(used[0] < 0)  # places past a window's end come first
            if len(used) == first:
                continue
            grad = net.learn([names[k] for k in used[first:]], place.reshape(index.shape) - first, y[[i for i, _ in part]])
            step += 1
            for k, v in grad.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)

    def scored() -> list[np.ndarray]:
        gates = np.concatenate([net.gates(net.inputs(names[lo : lo + 8192])[0]) for lo in range(0, len(names), 8192)] or [np.zeros((2, 1, 3 * HIDDEN), np.float32)], axis=1)
        flat = np.concatenate(windows)
        logits = np.concatenate([net.forward(gates, flat[lo : lo + 2048])[0] for lo in range(0, len(flat), 2048)])
        return np.split(logits, np.cumsum([len(w) for w in windows])[:-1])

    every = [(i, j) for i, w in enumerate(windows) for j in range(len(w))]
    few = max(1, 6000 // max(1, len(every)))  # small samples get more passes
    for _ in range(epochs[0] * few):
        order = g.permutation(len(every))[:EPOCH_WINDOWS]
        fit([every[k] for k in order])
    for _ in range(epochs[1] * min(few, 4)):
        chosen = []
        for i, v in enumerate(scored()):
            chosen.append((i, int(v.argmax())))
            if y[i] == 0:  # a few more that look toxic
                chosen += [(i, int(j)) for j in np.argsort(-v, kind="stable")[1:4]]
        g.shuffle(chosen)
        fit([tuple(c) for c in chosen])
    top = np.array([v.max() for v in scored()])
    edges = np.unique(top)
    cuts = (edges[1:] + edges[:-1]) / 2
    if len(cuts):
        toxic, other = np.sort(top[y == 1]), np.sort(top[y == 0])
        gain = 3 * np.searchsorted(other, cuts) / len(other) - np.searchsorted(toxic, cuts) / len(toxic)
        best = np.flatnonzero(gain == gain.max())
        net.p["bo"] -= np.float32(cuts[best[len(best) // 2]])
    return net.p


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded training sample: texts and labels, collected in the order of their ids' hash."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_y"))
    marks = marks.filter(crc_fold(F.col("_id"), FOLDS) != HELD_OUT)
    sized = documents(docs).groupBy("doc_id").agg(F.min(F.length("text")).alias("_n")).filter("_n > 0")
    both = sized.join(marks, sized["doc_id"] == marks["_id"]).select("_id", "_y", "_n", F.xxhash64("_id").alias("_h"))
    order = ("_h", "_id")
    ids = {}
    for y, most, size in ((1, POSITIVE_ROWS, POSITIVE_CHARS), (0, NEGATIVE_ROWS, NEGATIVE_CHARS)):
        chars = 0
        for r in both.filter(F.col("_y") == y).orderBy(*order).limit(most).collect():
            chars += r["_n"]
            if chars > size:
                break
            ids[r["_id"]] = y
    if not ids:
        return [], []
    own = docs.sparkSession.createDataFrame(list(ids.items()), "_id long, _y int")  # bounded by the parameters
    rows = documents(docs).join(F.broadcast(own), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("_id", "_y").agg(F.min(F.struct(F.length("text"), "text")).alias("t")).select("t.text", "_y", F.xxhash64("_id").alias("_h"), "_id").collect()
    rows.sort(key=lambda r: (r["_h"], r["_id"]))
    return [r["text"] for r in rows], [r["_y"] for r in rows]


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    p = train(*sample(docs, labels))

    def make():
        scorer = Scorer(p) if p is not None else None

        def kernel(texts):
            s = np.zeros(len(texts))
            if scorer:
                for lo in range(0, len(texts), 64):
                    s[lo : lo + 64] = scorer.scores(texts[lo : lo + 64])
            return {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}

        return kernel

    out = map_texts(documents(docs), make, "score double, predicted int")
    return out.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
