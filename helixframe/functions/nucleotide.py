"""Column functions on nucleotide strings, section ids, paths and CIGARs; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed: IUPAC letters by their set of bases (A 1, C 2, G 4, T 8), from the empty set (N) up.
IUPAC = "NACMGRSVTWYHKDBN"
# Fixed: IUPAC letters and their complements, upper case.
LETTERS, COMPLEMENTS = "ACGTRYKMBVDHSWN", "TGCAYRMKVBHDSWN"
BASES = {c: "".join(b for i, b in enumerate("ACGT") if n >> i & 1) for n, c in enumerate(IUPAC[:15])}


def normal(seq: Column) -> Column:
    """Upper case, U as T."""
    return F.translate(F.upper(seq), "U", "T")


def dna(text: Column) -> Column:
    """A nucleotide string for any text: its letters a-z, taken modulo 4 in alphabetical order."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]+", "")
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(normal(seq), LETTERS, COMPLEMENTS))


def encode_4bit(base: Column) -> Column:
    """Set of bases of a letter as an integer; N and unknown letters are 0."""
    at = F.instr(F.lit(IUPAC[1:15]), F.substring(normal(base), 1, 1))
    return F.when(F.length(base) == 0, 0).otherwise(at).cast("int")


def encode_4bit_text(seq: Column) -> Column:
    """A sequence as hexadecimal digits, one base set each; letters beyond IUPAC are 0."""
    return F.translate(F.regexp_replace(normal(seq), "[^ACMGRSVTWYHKDB]", "N"), IUPAC, "0123456789abcde")


def decode_4bit(code: Column) -> Column:
    return F.substring(F.lit(IUPAC), code.bitwiseAND(15) + 1, F.lit(1))


def complement_4bit(code: Column) -> Column:
    """Complement of a base set: its four bits in reverse order."""
    bit = lambda n: F.shiftright(code, n).bitwiseAND(1)
    return (bit(0) * 8 + bit(1) * 4 + bit(2) * 2 + bit(3)).cast("int")


def encode_2bit(base: Column) -> Column:
    """A 0, C 1, G 2, T 3; anything else 0."""
    at = F.instr(F.lit("ACGT"), F.substring(normal(base), 1, 1)) - 1
    return F.greatest(at, F.lit(0)).cast("int")


def pack_kmer(kmer: Column) -> Column:
    """Two bits a base, the first base lowest; 31 bases at most."""
    places = F.sequence(F.length(kmer), F.lit(1), F.lit(-1))
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc * 4 + encode_2bit(F.substring(kmer, i, F.lit(1))))


def gid(segment: Column, direction: Column) -> Column:
    return F.shiftleft(segment, 1).bitwiseOR(direction)


def gid_segment(g: Column) -> Column:
    return F.shiftright(g, 1)


def gid_direction(g: Column) -> Column:
    return g.bitwiseAND(1)


def gid_reverse(g: Column) -> Column:
    return g.bitwiseXOR(F.lit(1))


def mirror(length: Column, pos: Column) -> Column:
    """The place of ``pos`` on an axis of both strands, read from the other end."""
    return 2 * length - pos - 1


def windows(seq: Column, k: int, tail: int = 0) -> Column:
    """All overlapping windows of ``k`` letters, in one pass over the string, each with ``tail`` letters more where there are any."""
    more = f".{{0,{tail}}}" if tail else ""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}{more}))"), F.lit(1))


def cigar_tokens(path: Column) -> Column:
    """Runs of a path string (R a step on a, D a step on b; DR a match) as CIGAR tokens."""
    ops = F.replace(F.replace(F.replace(path, F.lit("DR"), F.lit("M")), F.lit("D"), F.lit("I")), F.lit("R"), F.lit("D"))
    parts = F.regexp_extract_all(ops, F.lit("(M+|I+|D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.concat(F.length(p).cast("string"), F.substring(p, 1, 1)))


def cigar(path: Column) -> Column:
    return F.array_join(cigar_tokens(path), "")


def cigar_reverse(path: Column) -> Column:
    """The CIGAR read from the path's end: the tokens in reverse order."""
    return F.array_join(F.reverse(cigar_tokens(path)), "")


def gapless_score(a: Column, b: Column, width: int = 16) -> Column:
    """Places of the first ``width`` letters of ``a`` that match ``b`` on one of the diagonals -1, 0, +1."""
    def hit(i: int) -> Column:
        own = F.substring(a, i + 1, 1)
        near = [F.substring(b, j + 1, 1) == own for j in (i - 1, i, i + 1) if j >= 0]
        test = near[0]
        for n in near[1:]:
            test = test | n
        return ((F.length(a) > i) & test).cast("int")

    return sum((hit(i) for i in range(1, width)), hit(0))


def steps(path: Column, step: str) -> Column:
    """Steps of one kind (R or D) in a path."""
    return F.length(F.regexp_replace(path, f"[^{step}]", ""))


def window_steps(path: Column, at: Column, width: int = 32, step: str = "D") -> Column:
    """Steps of one kind among the ``width`` steps from place ``at`` (0 first) on."""
    return steps(F.substring(path, at + 1, F.lit(width)), step)


def join_path(reverse: Column, seed: int, forward: Column) -> Column:
    """Path of an alignment: reverse extension, ``seed`` matches, forward extension."""
    return F.concat(reverse, F.lit("DR" * seed), forward)


def path_string(words: list[int], offset: int, length: int) -> str:
    """R/D string of packed path bits (least significant first, 1 is D)."""
    bits = "".join("RD"[w >> i & 1] for w in words for i in range(32))
    return bits[offset : offset + length]


def version(header: Column) -> Column:
    """Version number of a ``VN:Z:a.b.c`` field as ``0x10000 a + 0x100 b + c``; null without one."""
    part = lambda n: F.coalesce(F.try_element_at(F.split(F.regexp_extract(header, r"VN:Z:([0-9]+(?:\.[0-9]+)*)", 1), r"\."), F.lit(n)).try_cast("int"), F.lit(0))
    return F.when(header.rlike(r"VN:Z:[0-9]"), part(1) * 0x10000 + part(2) * 0x100 + part(3))


def one_line(command: Column) -> Column:
    """A command line fit for a tab-separated header."""
    return F.translate(command, "\t", " ")
