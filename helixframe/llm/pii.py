"""Personal data: pattern spans, and terms that reveal the entities found.

Base spans are emails, IPv4-like addresses, payment cards and phone numbers.
On top of them an information-theoretic step estimates, from co-occurrence over
the whole corpus, how much a term near an entity reveals about it. An entity is
protected as it stands and at its next more general level: an email's domain, an
address's first three numbers, a card's issuer (six digits), a phone's country and
area (four digits). A term ``t`` is disclosing for an entity ``e`` of either level
when ``PMI(t;e) >= alpha * IC(e)``, where ``IC(e) = log(N / n(e))`` and
``PMI = log(N n(t,e) / (n(t) n(e)))``: given ``t``, a reader recovers at least the
share ``alpha`` of the entity's information. All four counts are of distinct texts,
so that a text copied a thousand times counts once, as does a term that a text
repeats. What is met in a single context may be chance: the distinct contexts of
``t`` near ``e`` must reach ``min_support``.

Disclosing terms get spans of kind ``term`` within ``window`` words of the
entity they reveal; :func:`sanitise` generalises base spans to their kind
(``[EMAIL]``) and removes a term to ``[TERM]``. Documents without an entity are
never touched.

Nulls: a null text is an empty one, with no spans; a null doc_id is carried.
Repeated rows give repeated result rows. An empty table gives no rows. Texts of any
length are read whole, in time that grows with their length. A share equal to
``alpha`` discloses; spans that begin together are listed by kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_texts, materialise, rewrite_texts, slices

KINDS = ("email", "ip", "card", "phone")
WINDOW = 5
ALPHA = 0.8
MIN_SUPPORT = 2
FILTER_BITS = 1 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive runs after a look-behind: linear on digit strings of any length
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL_TAIL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            done = m.end()
    return out


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    if len(s) < 16 or len(s) > 37:
        return False
    d = s.replace(" ", "").replace("-", "")
    return 16 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in s) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind as listed, then start; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if _phone_ok(m[0])]
    return out


def words_outside(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """``(start, end, word)`` of the words (letters only, three or more, lower-cased) that touch none of ``spans``."""
    joined: list[list[int]] = []
    for s, e in sorted(spans):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(e, joined[-1][1])
        else:
            joined.append([s, e])
    begins = [s for s, _ in joined]
    out = []
    for m in _WORD.finditer(text):
        i = bisect_left(begins, m.end())  # the spans that begin before the word ends
        if not i or joined[i - 1][1] <= m.start():
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def near_terms(text: str, spans: list[tuple[int, int]], window: int) -> list[list[tuple[int, int, str]]]:
    """For each span the ``window`` words on either side of it; words inside any span are no terms."""
    words = words_outside(text, spans)
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    out = []
    for s, e in spans:
        before, after = bisect_right(ends, s), bisect_left(starts, e)
        out.append(words[max(0, before - window) : before] + words[after : after + window])
    return out


def general(kind: int, value: str) -> str:
    """The next more general level of an entity."""
    if kind == 0:
        return value.rpartition("@")[2].lower()
    if kind == 1:
        return value.rpartition(".")[0]
    return re.sub("[^0-9]", "", value)[: 6 if kind == 2 else 4]


def _key(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_NEAR = pa.list_(pa.struct([("term", pa.string()), ("entity", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
_SCAN = "text_key long, base array<struct<kind:int,start:int,end:int>>, near array<struct<term:string,entity:long,context:long,start:int,end:int>>"


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, base, near`` per row: base spans, and the terms around each of them.

    ``entity`` hashes an entity's kind and text, or its general level; ``context`` the words around it.
    One pass over the texts, without a shuffle.
    """

    def make():
        def kernel(texts):
            keys, base, near = [], [], []
            for t in texts:
                own = base_spans(t)
                keys.append(xxhash.xxh64_intdigest(t.encode(), seed=42) - (1 << 63))
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                rows = []
                for (k, s, e), words in zip(own, near_terms(t, [x[1:] for x in own], window) if own else ()):
                    ctx = _key(" ".join(w for _, _, w in words))
                    for ent in (_key(f"{k}:{t[s:e]}"), _key(f"{k}/{general(k, t[s:e])}")):
                        rows += [{"term": w, "entity": ent, "context": ctx, "start": a, "end": b} for a, b, w in words]
                near.append(rows)
            return {"text_key": pa.array(keys, pa.int64()), "base": pa.array(base, _SPAN), "near": pa.array(near, _NEAR)}

        return kernel

    return map_texts(documents(docs), make, _SCAN)


def _filter(hashes: DataFrame) -> np.ndarray | None:
    """The hashes (one column) as bits in a table of fixed size, None where there are none."""
    h = F.col(hashes.columns[0])
    bit = F.pmod(h, F.lit(FILTER_BITS))
    words = hashes.select(h.alias("h"), F.shiftright(bit, 5).alias("w"))
    words = words.select("w", F.expr("shiftleft(1L, cast(pmod(h, 32) as int))").alias("b"))
    # at most 2^15 rows by construction
    mask = {r["w"]: r["b"] for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect()}
    if not mask:
        return None
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, b in mask.items():
        table[w] = b
    return table


def disclosing_terms(scanned: DataFrame, docs: DataFrame, alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``term, entity, share``: terms whose PMI with an entity reaches ``alpha`` of the entity's information.

    ``scanned`` is :func:`scan` of ``docs``, written down. All documents count.
    The terms with enough support set bits in a filter of fixed size (1 Mbit);
    a second reading of the corpus counts only words whose bit is set, whatever
    their number, so it ships a row per word and flush and no word list. A second
    filter marks texts that have copies: they ship their marked words instead,
    and one of each text is counted, by task before anything is shuffled.
    """
    docs = documents(docs)
    seen = scanned.select("text_key", F.explode("near").alias("s")).select("s.term", "s.entity", "s.context", "text_key").distinct()
    joint = seen.groupBy("term", "entity").agg(F.count_distinct("context").alias("support"), F.count_distinct("text_key").alias("n_te"))
    joint = materialise(joint.filter(F.col("support") >= min_support).drop("support"))
    terms = _filter(joint.select(F.xxhash64("term").alias("h")))
    if terms is None:
        return joint.select("term", "entity", F.lit(0.0).alias("share"))
    copies = scanned.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1").select("text_key")
    sent = docs.sparkSession.sparkContext.broadcast((terms.tobytes(), None if (table := _filter(copies)) is None else table.tobytes()))

    def count(batches):
        bits = np.frombuffer(sent.value[0], np.uint32)
        copied = np.frombuffer(sent.value[1] or bytes(FILTER_BITS // 8), np.uint32)
        known: dict[str, list[str]] = {}
        counts: dict[str, int] = {}
        held: dict[int, list[str]] = {}

        def flush():
            n = len(counts) + len(held)
            out = pa.RecordBatch.from_pydict({
                "terms": pa.array([[x] for x in counts] + list(held.values()), pa.list_(pa.string())),
                "n": pa.array([*counts.values(), *[1] * len(held)], pa.int64()),
                "text_key": pa.array([None] * (n - len(held)) + list(held), pa.int64()),
            })
            counts.clear()
            held.clear()
            return out

        def is_set(table, h):
            h %= FILTER_BITS
            return int(table[h >> 5]) >> (h & 31) & 1

        def marked(word):
            return [m[0] for m in _WORD.finditer(word) if is_set(bits, xxhash.xxh64_intdigest(m[0].encode(), seed=42))]

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                own: set[str] = set()
                for w in set(t.lower().split()):
                    hit = known.get(w)
                    if hit is None:
                        if len(known) > 500_000:
                            known.clear()
                        hit = known[w] = marked(w)
                    own.update(hit)
                key = xxhash.xxh64_intdigest(t.encode(), seed=42) - (1 << 63)
                if is_set(copied, key):
                    held[key] = list(own)
                    continue
                for x in own:
                    counts[x] = counts.get(x, 0) + 1
            if len(counts) > 200_000 or len(held) > 10_000:
                yield flush()
        yield flush()

    def tally(batches):
        total: Counter[str] = Counter()
        for b in batches:
            total.update(b.column(0).flatten().to_pylist())
            if len(total) > 200_000:
                yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
                total.clear()
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    # written down, as both halves would read the corpus again
    read = materialise(docs.select("text").mapInArrow(count, "terms array<string>, n long, text_key long"))
    once = read.filter("text_key is not null").groupBy("text_key").agg(F.first("terms").alias("terms")).select("terms")
    n_t = read.filter("text_key is null").select(F.col("terms")[0].alias("term"), "n").unionByName(once.mapInArrow(tally, "term string, n long"))
    n_t = n_t.groupBy("term").agg(F.sum("n").alias("n_t"))
    n_e = seen.select("entity", "text_key").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    total = float(max(scanned.select("text_key").distinct().count(), 2))
    ic = F.log(F.lit(total) / F.col("n_e"))
    pmi = F.log(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    out = joint.join(n_e, "entity").join(n_t, "term", "left")
    out = out.withColumn("n_t", F.greatest(F.coalesce("n_t", F.lit(0)), "n_te"))
    out = out.withColumn("share", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)))
    return out.filter(F.col("share") >= alpha).select("term", "entity", "share")


def find(docs: DataFrame, window: int = WINDOW, alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``doc_id, text_key, base, terms`` per row: base spans and spans of disclosing terms (kind 4).

    (term, entity) pairs meet the documents in a join on their hash, so no list
    of them goes to a task whole.
    """
    scanned = materialise(scan(docs, window))
    pairs = disclosing_terms(scanned, docs, alpha, min_support)
    pairs = materialise(pairs.select(F.xxhash64("term", "entity").alias("pair")).distinct())
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    if pairs.isEmpty():
        return scanned.select("doc_id", "text_key", "base", none.alias("terms"))
    near = scanned.select("doc_id", "text_key", F.explode("near").alias("c"))
    near = near.select("doc_id", "text_key", "c.start", "c.end", F.xxhash64("c.term", "c.entity").alias("pair"))
    hits = near.join(pairs, "pair", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    hits = hits.agg(F.array_sort(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("terms"))
    same = scanned["doc_id"].eqNullSafe(hits["d"]) & (scanned["text_key"] == hits["k"])
    return scanned.join(hits, same, "left").select("doc_id", "text_key", "base", F.coalesce("terms", none).alias("terms"))


def sanitise(docs: DataFrame, window: int = WINDOW, alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``docs`` with each entity generalised to its kind (``[EMAIL]``) and each disclosing term to ``[TERM]``.

    All other columns and null texts stay as they are. Overlapping spans are
    replaced as one, named by the first. Where no term discloses anything, texts
    are rewritten in place without a shuffle; else the documents concerned meet
    their term spans in a join on (doc_id, hash of the text).
    """
    found = find(docs, window, alpha, min_support).filter(F.size("terms") > 0)
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("terms").alias("_t")).distinct()
    found = materialise(found)
    names = [f"[{k.upper()}]" for k in (*KINDS, "term")]

    def clean(text, extra):
        spans = sorted([(s, e, k) for k, s, e in base_spans(text)] + [(x["start"], x["end"], 4) for x in extra or ()])
        out, done = [], 0
        for s, e, k in spans:
            if s >= done:
                out += [text[done:s], names[k]]
            done = max(done, e)
        return "".join(out) + text[done:] if spans else text

    if found.isEmpty():
        return rewrite_texts(docs, lambda: lambda texts: [t and clean(t, ()) for t in texts])
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumn("_key", F.expr("xxhash64(coalesce(row.text, '')) ^ shiftleft(1L, 63)"))
    both = row.join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    flat = both.select(F.col("_t"), *[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index("text") + 1

    def run(batches):
        for b in slices(batches):
            new = [t and clean(t, x) for t, x in zip(b.column(at).to_pylist(), b.column(0).to_pylist())]
            arrays = b.columns[1:]
            arrays[at - 1] = pa.array(new, b.column(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)])
    out = flat.mapInArrow(run, schema)
    return out.toDF(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    """The span digest of each document: counts by kind, hash of the base spans, all spans spelled out."""
    found = find(docs)
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    spell = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *[count(k) for k in range(4)],
        F.sha2(spell(F.col("base")), 256).alias("base_sha256"),
        spell(F.concat("base", "terms")).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
