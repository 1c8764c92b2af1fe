import itertools
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions.nucleotide import cigar
from helixframe.functions.params import Params
from helixframe.operators import graph as G
from helixframe.operators import mapper as M
from helixframe.operators.align import extend, rescore
from helixframe.operators.ordering import numbered
from helixframe.streaming.drain import drain, parallel

g = random.Random(11)
SEQ = "".join(g.choice("ACGT") for _ in range(200))
P = Params(k=14, score=1)


def reads(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "read_ord long, seq string")


def results(df):
    rows = df.select("read_ord", "ordinal", "score", "sections", cigar(F.col("path")).alias("cigar")).collect()
    return sorted(((r["read_ord"], r["ordinal"], r["score"], r["cigar"], [tuple(s) for s in r["sections"]]) for r in rows), key=lambda x: x[:2])


@pytest.fixture(scope="module")
def linear(spark):
    return G.build(spark.createDataFrame([("seq1", SEQ, 0)], "name string, seq string, o long"), order="o")


def test_exact_reads(spark, linear):
    got = results(M.align(linear, reads(spark, [SEQ[80:160], SEQ[50:130], SEQ[130:200]]), P))
    fw = [x for x in got if x[4][0][0] == 0]
    assert [(x[0], x[2], x[3], x[4][0][2]) for x in fw] == [(0, 80, "80M", 80), (1, 80, "80M", 50), (2, 70, "70M", 130)]


def test_default_threshold_leaves_short_reads_out(spark, linear):
    assert M.align(linear, reads(spark, [SEQ[80:160]]), Params(k=14)).count() == 0


def test_read_with_changes(spark, linear):
    read = SEQ[20:60] + SEQ[62:100] + "A" + SEQ[100:150]
    got = results(M.align(linear, reads(spark, [read]), P))
    best = max(got, key=lambda x: x[2])
    assert best[2] >= 128 - 2 * 4 and "2D" in best[3]


def test_reverse_read(spark, linear):
    read = SEQ[40:120].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    got = results(M.align(linear, reads(spark, [read]), P))
    assert (got[0][2], got[0][3], got[0][4][0][:2]) == (80, "80M", (1, 0))


def test_paths_through_sections(spark):
    segs = spark.createDataFrame([("11", SEQ[:80], 0), ("12", SEQ[80:160], 1), ("13", SEQ[160:], 2)], "name string, seq string, o long")
    links = spark.createDataFrame([("11", 0, "12", 0, 3), ("12", 0, "13", 0, 4), ("11", 0, "13", 0, 5)], "src string, src_ori int, dst string, dst_ori int, o long")
    ref = G.build(segs, links, "o")
    got = results(M.align(ref, reads(spark, [SEQ[50:180], SEQ[40:80] + SEQ[160:200]]), P))
    first = max((x for x in got if x[0] == 0), key=lambda x: x[2])
    assert (first[2], first[3]) == (130, "130M")
    assert [(s[0], s[2], s[4]) for s in first[4]] == [(0, 50, 30), (2, 0, 80), (4, 0, 20)]
    assert [s[6] for s in first[4]] == [0, 60, 220]
    second = max((x for x in got if x[0] == 1), key=lambda x: x[2])
    assert (second[3], [s[0] for s in second[4]]) == ("80M", [0, 4])


def test_gapless_filter_ends_an_extension():
    """A side whose first 16 letters hardly match is not extended, though it would match further on; a lower threshold lets it through."""
    r = random.Random(6)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    seed, tail, head = text(14), text(120), text(40)
    a, b = head + seed + "AAAAAAAAAAAAAAAAAA" + tail, head + seed + "CCCCCCCCCCCCCCCCCC" + tail
    flip = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    ref, query = (M.Sequences({0: s, 1: flip(s)}, {}) for s in (a, b))
    plain = Params(k=14, score=1, gi=1, ge=1, x=1, xdrop=100)
    closed = M.extend_seed(ref, query, 0, 40, 0, 40, plain.resolved())
    opened = M.extend_seed(ref, query, 0, 40, 0, 40, Params(**{**vars(plain), "gapless": -1}).resolved())
    assert (closed.score, closed.path) == (54, "DR" * 54) and opened.score > 120
    # shorter than the window: not filtered
    near = M.extend_seed(*(M.Sequences({0: s[:64], 1: flip(s[:64])}, {}) for s in (a, b)), 0, 40, 0, 40, plain.resolved())
    assert near.score == 54


def test_numbering_with_few_keys(spark):
    rows = spark.range(5000).selectExpr("id", "id % 3 as key").repartition(7)
    got = sorted((r["n"], r["key"], r["id"]) for r in numbered(rows, "key", "id").collect())
    want = sorted((i % 3, i) for i in range(5000))
    assert got == [(n, *kv) for n, kv in enumerate(want)]
    assert numbered(rows.limit(0), "key", "id").count() == 0


def test_long_sequences_are_cut_into_chunks(spark):
    text = "".join(g.choice("ACGTN") if g.random() < 0.1 else g.choice("ACGT") for _ in range(2 * G.CHUNK + 37))
    for n in (len(text), G.CHUNK, G.CHUNK + 1, 13, 14, 0):
        df = spark.createDataFrame([(1, text[:n])], "i int, s string")
        got = [(r["pos"], r["kmer"], r["after"]) for r in G.linear_kmers(df, "i", "s", 14, 17).orderBy("pos").collect()]
        assert got == [(p, text[p : p + 14], text[:n][p + 14 : p + 31]) for p in range(n - 13) if "N" not in text[p : p + 14]]


def test_empty_inputs(spark, linear):
    assert M.align(linear, reads(spark, ["", "ACGT"]), P).count() == 0
    assert M.align(linear, reads(spark, ["ACGT"]).limit(0), P).count() == 0


def test_sections_and_paths_agree():
    seqs = {0: "ACGTACGTAC", 1: "GTACGTACGT", 2: "TTTTGGGG", 3: "CCCCAAAA"}
    ref = M.Sequences(seqs, {0: [2], 3: [1]})
    read = "GTACTTTTGG"
    p = Params(k=4, score=1, m=1, x=2, gi=2, ge=1).resolved()
    r = M.extend_seed(ref, M.Sequences({0: read, 1: "CCAAAAGTAC"}, {}), 0, 6, 0, 0, p)
    assert r.score == 10 == rescore(r.path, "GTACTTTTGG", read, p)
    assert [s[:2] + s[4:6] for s in r.sections] == [(0, 0, 4, 4), (2, 0, 6, 6)]
    assert sum(s[4] + s[5] for s in r.sections) == len(r.path)


@pytest.mark.parametrize("cuts", [[], [150, 300, 460]])
def test_several_gaps_beyond_the_xdrop(cuts):
    """Insertions on the reference, then on the read, each within the X-drop and more than it together."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    b = text(414)
    a = b[:114] + text(30) + b[114:214] + text(30) + b[214:314] + text(30) + b[314:] + text(900)
    flip = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]

    def held(s, at):
        parts = [s[i:j] for i, j in zip([0, *at], [*at, len(s)])]
        seq = {2 * i + d: flip(x) if d else x for i, x in enumerate(parts) for d in (0, 1)}
        return M.Sequences(seq, {2 * i: [2 * i + 2] for i in range(len(at))} | {2 * i + 3: [2 * i + 1] for i in range(len(at))})

    p = Params(k=14, score=1).resolved()
    want = 400 - 3 * (p.gi + 30 * p.ge) + 14
    on_ref = M.extend_seed(held(a, cuts), held(b, []), 0, 0, 0, 0, p)
    assert on_ref.score >= want and rescore(on_ref.path, a, b, p) == on_ref.score
    on_read = M.extend_seed(held(b, []), held(a, []), 0, 0, 0, 0, p)
    assert on_read.score >= want and rescore(on_read.path, b, a, p) == on_read.score


def flip(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def bubbles(parts):
    """A reference of sections that part and meet again: each item lists the texts between which a path chooses."""
    seq, succ, ends = {}, {}, []
    for choice in parts:
        own = [len(seq) + 2 * i for i in range(len(choice))]
        for g_, text in zip(own, choice):
            seq[g_], seq[g_ + 1] = text, flip(text)
        for e in ends:
            succ[e] = own
        for o in own:
            succ[o + 1] = [e + 1 for e in ends]
        ends = own
    return M.Sequences(seq, succ)


@pytest.mark.parametrize("seed", range(8))
def test_bubbles_against_all_paths(seed):
    """Fronts that meet go on as one: the score is that of the best of all paths, the path gives it."""
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    parts = [[text(20)]]
    for _ in range(5):
        parts += [[text(r.choice((1, 1, 2, 6))) for _ in range(r.choice((2, 3)))], [text(r.randrange(1, 12))]]
    paths = ["".join(x) for x in itertools.product(*parts)]
    read = list(r.choice(paths) + text(10))
    for _ in range(seed):
        i = r.randrange(14, len(read))
        read[i : i + r.randrange(2)] = text(r.randrange(3))
    read = "".join(read)
    p = Params(k=14, score=1, m=1, x=r.choice((1, 2)), gi=r.choice((1, 2)), ge=1, xdrop=30, gapless=-1).resolved()
    got = M.extend_seed(bubbles(parts), M.Sequences({0: read, 1: flip(read)}, {}), 0, 0, 0, 0, p)
    assert got.score == 14 + max(extend(x[14:], read[14:], p).score for x in paths)
    taken = "".join(bubbles(parts).seq[s[0]][s[2] : s[2] + s[4]] for s in got.sections)
    assert rescore(got.path, taken, read, p) == got.score and sum(s[4] + s[5] for s in got.sections) == len(got.path)


def test_many_bubbles():
    """2^60 paths: work grows with the sections. The one that the read took is found, and is whole on the other strand too."""
    r = random.Random(2)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    parts = [[text(30)]]
    for _ in range(60):
        parts += [["A", "C"], [text(9)]]
    read = "".join(r.choice(c) for c in parts)
    ref = bubbles(parts)
    p = Params(k=14, score=1).resolved()
    got = M.extend_seed(ref, M.Sequences({0: read, 1: flip(read)}, {}), 0, 0, 0, 0, p)
    assert (got.score, got.path) == (len(read), "DR" * len(read))
    assert "".join(ref.seq[s[0]][s[2] : s[2] + s[4]] for s in got.sections) == read
    back = M.extend_seed(ref, M.Sequences({0: flip(read), 1: read}, {}), max(ref.seq), 0, 0, 0, Params(k=9, score=1).resolved())
    assert back.score == len(read)


def test_paths_that_fail_the_first_window_go_missing_alone():
    """Of two branches within the first window only the one that looks alike is followed."""
    r = random.Random(4)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    seed, tail = text(14), text(60)
    ref = bubbles([[seed], ["A" * 17, tail[:17]], [tail[17:]]])
    read = seed + tail
    got = M.extend_seed(ref, M.Sequences({0: read, 1: flip(read)}, {}), 0, 0, 0, 0, Params(k=14, score=1).resolved())
    assert got.path == "DR" * 74 and [s[0] for s in got.sections] == [0, 4, 6]


def test_cycles_end():
    unit = "ACGTTGCATTACGGATCCAG"
    ref = M.Sequences({0: unit, 1: flip(unit)}, {0: [0], 1: [1]})
    read = unit * 6
    got = M.extend_seed(ref, M.Sequences({0: read, 1: flip(read)}, {}), 0, 0, 0, 0, Params(k=14, score=1).resolved())
    assert (got.score, len(got.sections)) == (120, 6)


def result(score, *sections):
    """A result of gapless sections ``(aid, apos, bpos, length)`` on query 0."""
    rows, at = [], 0
    for aid, apos, bpos, n in sections:
        rows.append((aid, 0, apos, bpos, n, n, at))
        at += 2 * n
    return M.Result(score, "DR" * (at // 2), rows, M._track(rows, "DR" * (at // 2)))


def settled(old, new, q, r=None, g=0, width=4):
    """Which results stay, as numbers: 0 the old one, 1 the new one; the seed lies at query place ``q`` of the new one."""
    r = next(t[2] for t in new.track if t[0] == q) if r is None else r
    results = [old]
    M.settle(results, new, q, g, r, width)
    return [[old, new].index(x) for x in results]


def test_upkeep_by_head_and_tail():
    old = result(20, (0, 10, 10, 30))  # 10 to 40 on both
    far = lambda score, apos, bpos, n: result(score, (0, apos, bpos, n))
    # neither edge shared: both stay, whatever the scores
    assert settled(old, far(99, 5, 5, 40), 20) == settled(old, far(1, 100, 15, 20), 20) == [0, 1]
    # one edge shared, longer on the other: the new one unless its score is lower, which leaves both
    assert settled(old, far(20, 5, 5, 35), 20) == settled(old, far(20, 10, 10, 35), 20) == [1]
    # equal head and a longer tail but lower score: nearest results leave it; its section begins where the old one's does
    assert settled(old, far(19, 10, 10, 35), 20) == [1] and settled(old, far(19, 5, 5, 35), 20) == [0, 1]
    # one edge shared, shorter on the other; both shared
    assert settled(old, far(99, 10, 10, 20), 20) == settled(old, far(99, 20, 20, 20), 25) == settled(old, far(99, 10, 10, 30), 20) == [0]


def test_upkeep_over_sections():
    old = result(20, (0, 5, 0, 10), (2, 0, 10, 10), (4, 0, 20, 10))
    parts = ((0, 5, 0, 10), (2, 0, 10, 10), (4, 0, 20, 10))
    assert settled(old, result(20, *parts, (6, 0, 30, 5)), 12, g=2) == [1]  # goes on into one more section
    assert settled(old, result(20, *parts[1:]), 12, g=2) == [0] and settled(old, result(20, *parts[:2]), 12, g=2) == [0]
    # longer at the tail, shorter at the head: the new one; the other way round: the old one
    assert settled(old, result(1, *parts[1:], (6, 0, 30, 5)), 12, g=2) == [1]
    assert settled(result(1, *parts[1:], (6, 0, 30, 5)), old, 12, g=2) == [0]
    assert M.compare(old.sections, old.sections[:2], M._end) == (1, 2) and M.compare([], old.sections, M._end) == (-1, 0)


def test_nearest_results_and_the_band():
    beside = [result(5, (0, 100, 0, 30)), result(5, (0, 300, 0, 30))]
    assert M.covered(beside, 10, 0, 112, 4) and not M.covered(beside, 10, 0, 115, 4) and not M.covered(beside, 99, 0, 199, 4)
    M.settle(beside, result(5, (0, 200, 0, 30)), 10, 0, 210, 4)
    assert [x.sections[0][2] for x in beside] == [100, 300, 200]
    # nothing runs at the seed's place, but a section begins where the seed's does
    short = [result(5, (0, 50, 0, 8))]
    M.settle(short, result(2, (0, 50, 0, 30)), 20, 0, 70, 4)
    assert [x.score for x in short] == [2]


def test_too_many_paths_is_an_error():
    n = 12
    seqs = {i: "ACGT" for i in range(2 * 2 * n)}
    succ = {i: [2 * (i // 2 // 2 + 1) * 2, 2 * (i // 2 // 2 + 1) * 2 + 2] for i in range(0, 4 * n - 4, 2)}
    with pytest.raises(ValueError):
        M.Sequences(seqs, succ).paths(0, 0, 100)


def test_drain_equals_batch(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id % 7 as k")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    out = drain(spark, str(tmp_path / "in"), rows.schema, lambda s: s.filter("k < 3"), str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=2)
    assert sorted(r["id"] for r in out.collect()) == [i for i in range(1000) if i % 7 < 3]
    # a second run finds nothing new
    assert drain(spark, str(tmp_path / "in"), rows.schema, lambda s: s.filter("k < 3"), str(tmp_path / "out"), str(tmp_path / "state")).count() == out.count()


def test_parallel(spark):
    assert parallel(spark, range(5), lambda x: x * x) == [0, 1, 4, 9, 16] and parallel(spark, [], abs) == []
