"""Secret scans over a trigram inverted index; DataFrame functions only.

Each rule is a regular expression. From it a Boolean query over trigrams that
every match must contain is derived: an AND of ORs (of ANDs, for the spellings of
a literal). The index holds postings ``(trigram, row)`` for the trigrams that some
query names, in lower-cased text. Intersecting a query's postings gives the rows
whose text is then verified with the expression itself; a rule without mandatory
trigrams (a run of hex digits) scans every text where it lies. Only texts of
candidates are sent anywhere; what meets the other rows is their spans.

A match's place is the length of the text between matches and of the matches
before it, in code points. Base kinds are ``assign``, ``access`` and ``hex``;
further kinds add spans.

Nulls: a null text is an empty one, with no spans; a null doc_id is carried, and
its rows are joined null-safely. Rows are keyed by doc_id and the MD5 of the text:
repeated rows share postings and spans, and each gives its result row. An empty
table gives no rows. Texts of any length are read whole, with any number of spans;
spans that begin together are listed as the rules are.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` of ``pattern`` has ``least`` characters or more.

    ``guard`` is put before the pattern where it is run; it must not change the
    matches (a look-behind that starts a run of characters at its beginning).
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    guard: str = ""


RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, "(?<![0-9a-f])"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = 3  # the first rules of RULES
MOST = 64  # spellings of a literal that are followed
MASK = 1 << 23  # bits of the filter of candidates
PART = 256  # matches that are placed at a time

Query = tuple[tuple[frozenset[str], ...], ...]
"""AND over clauses; a clause is an OR over sets of trigrams that occur together."""


class Parser:
    """Expressions as nodes: ``(set of characters or None,)`` for one character, ``("seq", nodes)``, ``("or", nodes)``, ``("rep", low, high, node)``.

    Takes literals, classes, groups, alternatives and repeats; anything else is a ``ValueError``.
    """

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.text[self.at - n : self.at]

    def parse(self):
        node = self.ways()
        if self.peek():
            raise ValueError(f"{self.text}: unbalanced")
        return node

    def ways(self):
        out = [self.sequence()]
        while self.peek() == "|":
            self.take()
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("or", out)

    def sequence(self):
        out = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom()
            while self.peek() and self.peek() in "?*+{":
                node = ("rep", *self.bounds(), node)
            out.append(node)
        return "seq", out

    def bounds(self) -> tuple[int, int | None]:
        c = self.take()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.text.index("}", self.at)
        low, comma, high = self.take(end - self.at).partition(",")
        self.take()
        return int(low or 0), (int(high) if high else None) if comma else int(low)

    def atom(self):
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                if self.take(2) != "?:":
                    raise ValueError(f"{self.text}: no such group")
            node = self.ways()
            if self.take() != ")":
                raise ValueError(f"{self.text}: unbalanced")
            return node
        if c == "[":
            return (self.members(),)
        if c == ".":
            return (None,)
        if c in "^$":
            raise ValueError(f"{self.text}: no anchors")
        return (frozenset(self.escaped() if c == "\\" else c),)

    def escaped(self) -> str:
        c = self.take()
        if c == "x":
            return chr(int(self.take(2), 16))
        if c.isalnum():
            raise ValueError(f"{self.text}: no such escape")
        return c

    def members(self) -> frozenset[str] | None:
        negated = self.peek() == "^" and bool(self.take())
        out: set[str] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            c = self.escaped() if c == "\\" else c
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                d = self.take()
                d = self.escaped() if d == "\\" else d
                out |= {chr(x) for x in range(ord(c), ord(d) + 1)}
            else:
                out.add(c)
        self.take()
        return None if negated else frozenset(out)


def trigram_query(pattern: str) -> Query:
    """Trigrams that every match of ``pattern`` contains, in lower case; empty where none is mandatory or the pattern is beyond :class:`Parser`."""
    clauses: list[tuple[frozenset[str], ...]] = []

    def note(spellings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in spellings}
        if sets and all(sets):
            clauses.append(tuple(sorted(sets, key=sorted)))

    def spell(nodes) -> set[str] | None:
        """All strings of a short part in lower case, or None; notes what it can on the way."""
        done: set[str] | None = {""}
        for node in nodes:
            own = one(node)
            if own is not None and done is not None and len(done) * len(own) <= MOST:
                done = {a + b for a, b in product(done, own)}
                continue
            if done is not None and done != {""}:
                note(done)
            done = own
        return done

    def one(node) -> set[str] | None:
        if len(node) == 1:
            chars = {c.lower() for c in node[0] or ()}
            return chars if 0 < len(chars) <= 8 else None
        if node[0] == "seq":
            return spell(node[1])
        kept = len(clauses)
        if node[0] == "or":
            ways = [one(way) for way in node[1]]
            del clauses[kept:]  # what one way needs is not mandatory
            whole = None if None in ways else set().union(*ways)
            return whole if whole and len(whole) <= MOST else None
        low, high, item = node[1:]
        if (low, high) == (0, 1):
            own = one(item)
            del clauses[kept:]
            return None if own is None else own | {""}
        if low == high and low <= 8:
            return spell([item] * low)
        if low > 0:
            own = spell([item] * min(low, 3))
            if own is not None:
                note(own)
        return None

    try:
        rest = one(Parser(pattern).parse())
    except ValueError:
        return ()
    if rest:
        note(rest)
    return tuple(dict.fromkeys(clauses))


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """All trigrams that the rules' queries name, in order."""
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for way in clause for g in way})


def keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("text_key", F.md5(F.encode("text", "utf-8")))


def index(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index of ``rows`` (``doc_id, text_key, text``): postings ``trigram, doc_id, text_key``."""
    terms = F.array(*[F.lit(t) for t in vocabulary(rules)])
    low = rows.select("doc_id", "text_key", F.lower("text").alias("low"))
    found = F.filter(terms, lambda t: F.contains(F.col("low"), t))
    return low.select("doc_id", "text_key", F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, text_key, rules``: a bit for each rule whose query the row's postings satisfy.

    Postings of a row meet in one pre-aggregated group (a bit for each trigram),
    so no posting list, however long, is gathered anywhere.
    """
    terms = vocabulary(rules)
    words = -(-len(terms) // 60)
    place = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("trigram")) - 1
    marks = [F.bit_or(F.when(F.floor(place / 60) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 60).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    rows = postings.groupBy("doc_id", "text_key").agg(*marks)

    def together(way: frozenset[str]) -> Column:
        test = F.lit(True)
        for w in range(words):
            bits = sum(1 << terms.index(t) - 60 * w for t in way if terms.index(t) // 60 == w)
            if bits:
                test &= F.col(f"w{w}").bitwiseAND(F.lit(bits)) == bits
        return test

    hit = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        query = trigram_query(r.pattern)
        if query:
            test = F.lit(True)
            for clause in query:
                anyway = F.lit(False)
                for way in clause:
                    anyway |= together(way)
                test &= anyway
            hit = hit + F.when(test, F.lit(1 << i)).otherwise(F.lit(0))
    return rows.select("doc_id", "text_key", hit.alias("rules")).filter("rules <> 0")


def spans(rule: Rule, number: int) -> Column:
    """Spans of one rule in ``text``: ``array<struct<start, rule, end>>``, whole matches whose group is long enough."""
    pattern = F.lit(rule.guard + rule.pattern)
    # each step reads the arrays made once by the one before (a one-element transform binds a name)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    part = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    none = F.array().cast("array<struct<start:long,rule:int,end:long>>")

    def bound(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def placed(m: Column) -> Column:
        gaps = F.split(F.col("text"), rule.guard + rule.pattern, -1)
        every = F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("g"), part.alias("p"))

        def step(acc, x):
            begin = acc["at"] + F.length(x["g"])
            end = begin + F.length(x["m"])
            own = F.struct(begin.cast("long").alias("start"), F.lit(number).alias("rule"), end.cast("long").alias("end"))
            more = F.when(F.length(x["p"]) >= rule.least, F.array_append(acc["out"], own)).otherwise(acc["out"])
            return F.struct(end.cast("long").alias("at"), more.alias("out"))

        def part_step(acc, x):
            done = F.aggregate(x, F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return bound(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))

        # an array grows by copies, so matches are placed in parts
        def all_parts(e):
            cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / PART).cast("int")), lambda i: F.slice(e, i * PART + 1, PART))
            return F.aggregate(cut, F.struct(F.lit(0).cast("long").alias("at"), F.array(none).alias("out")), part_step, lambda acc: F.flatten(acc["out"]))

        return bound(every, all_parts)

    return F.element_at(F.transform(F.array(whole), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m))), 1)


def _maybe(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose key may be among ``ids``, by a filter of ``MASK`` bits (1 MB is broadcast); a join decides afterwards."""
    place = F.pmod(F.xxhash64("text_key"), F.lit(MASK))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    mask = ids.select(word.alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("_w").agg(F.bit_or("b").alias("_bits"))
    marked = rows.withColumn("_word", word).join(F.broadcast(mask), F.col("_word") == F.col("_w"))
    return marked.filter(F.call_function("getbit", F.col("_bits"), bit) == 1).select(*rows.columns)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``: spans sorted by start, then by rule as listed."""
    rows = keyed(docs)
    none = F.array().cast("array<struct<start:long,rule:int,end:long>>")
    by_index = [bool(trigram_query(r.pattern)) for r in rules]
    found = materialise(candidates(index(rows, rules), rules))
    texts = _maybe(rows, found).distinct()  # repeated rows are verified once
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("rules").alias("_r"))
    texts = texts.join(found, texts["doc_id"].eqNullSafe(found["_d"]) & (texts["text_key"] == found["_k"]))
    some = [F.when(F.col("_r").bitwiseAND(F.lit(1 << i)) != 0, spans(r, i)).otherwise(none) for i, r in enumerate(rules) if by_index[i]]
    verified = texts.select("_d", "_k", F.concat(none, *some).alias("_spans")).filter(F.size("_spans") > 0)
    every = [spans(r, i) for i, r in enumerate(rules) if not by_index[i]]
    read = rows.select("doc_id", "text_key", F.concat(none, *every).alias("own"))
    both = read.join(verified, read["doc_id"].eqNullSafe(verified["_d"]) & (read["text_key"] == verified["_k"]), "left")
    return both.select("doc_id", F.array_sort(F.concat("own", F.coalesce("_spans", none))).alias("spans"))


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, hash of the base spans and all spans spelled out, for every row of ``docs``."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = F.filter("spans", lambda x: x["rule"] < BASE)
    spell = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(kinds, x["rule"] + 1), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["rule"] == k)).cast("long").alias(f"n_{rules[k].kind}")
    return scan(docs, rules).select("doc_id", *[count(k) for k in range(BASE)], F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))
