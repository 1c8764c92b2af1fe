import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.params import BWA, Params
from helixframe.operators import graph as G
from helixframe.operators import mapper as M
from helixframe.operators import screen as S
from helixframe.operators.align import Fill

g = random.Random(23)
FLIP = str.maketrans("ACGT", "TGCA")


def dna(n, letters="ACGT"):
    return "".join(g.choice(letters) for _ in range(n))


def changed(s, share):
    out = []
    for c in s:
        x = g.random()
        out.append(g.choice("ACGT") if x < share else c + dna(1) if x < 1.3 * share else "" if x < 1.6 * share else c)
    return "".join(out)


@pytest.mark.parametrize("p", [Params(k=14, score=40), Params(k=14, score=30, gi=0, ge=2), Params(k=14, score=200, m=2, x=1, gi=4, ge=2, xdrop=30), BWA])
def test_scores_are_those_of_the_extension(p):
    """Every settled score is the score of ``Fill``; one that stops early has more than was asked for; long ones are left open."""
    p = p.resolved()
    pairs = [(dna(g.choice((0, 1, 15, 90, 300))), dna(g.choice((0, 1, 15, 90, 300)))) for _ in range(60)]
    for _ in range(90):
        a = dna(g.choice((30, 120, 250, 700)))
        pairs.append((a, changed(a, g.choice((0, 0.05, 0.15, 0.3)))[: g.choice((20, 200, 900))]))
    a, b = "".join(x + "\0" for x, _ in pairs), "".join(y + "\0" for _, y in pairs)
    alen, blen = (np.array([len(x[i]) for x in pairs]) for i in (0, 1))
    index = S.Index.build(G_rows(), {0: a, 1: a[::-1].translate(FLIP)}, {}, 14)
    read = S._UPPER[np.frombuffer(b.encode(), np.uint8)]
    side = S.Side(np.cumsum(alen + 1) - alen - 1, alen, np.cumsum(blen + 1) - blen - 1, blen, 1, np.zeros(len(pairs), bool))
    for enough in (1 << 20, 25):
        got = S.scores(index, read, side, p, np.full(len(pairs), enough))
        opened = 0
        for n, (x, y) in enumerate(pairs):
            fill = Fill(y, p)
            fill.grow(fill.root(), x)
            if got[n] > 1 << 20:
                opened += 1
                assert len(x) > S.ROWS
            elif got[n] > enough:
                assert fill.score >= got[n]
            else:
                assert fill.score == got[n], (x, y)
        assert enough == 25 or opened


def G_rows():
    import pyarrow as pa

    return pa.table({"kmer": pa.array(["A" * 14]), "gid": pa.array([0], pa.int32()), "pos": pa.array([0], pa.int32()), "route": pa.array([[]], pa.list_(pa.int32()))})


def results(df):
    rows = df.select("read_ord", "ordinal", "score", "path", "sections").collect()
    return sorted((r["read_ord"], r["ordinal"], r["score"], r["path"], [tuple(s) for s in r["sections"]]) for r in rows)


@pytest.fixture(scope="module")
def texts():
    """Sections with repeats, N and ambiguous letters."""
    unit = dna(40)
    return [dna(400), dna(90) + unit + dna(60) + unit + dna(80), dna(50) + "N" + dna(70) + "R" + dna(120), dna(30), "", dna(260) + unit]


@pytest.fixture(scope="module")
def queries(texts):
    out = []
    for s in [*texts, *(x + y for x, y in zip(texts, texts[1:]))]:
        for share in (0, 0.03, 0.1):
            t = changed(s, share)
            out += [dna(g.randrange(90)) + t + dna(g.randrange(90)), t.translate(FLIP)[::-1]]
    long = dna(3000) + texts[0] + dna(4000) + texts[1].translate(FLIP)[::-1]
    return [*out, long, long.lower(), "", "ACGT", dna(200), texts[0][:90] + "ß" + texts[0][90:], "é" * 40 + texts[5], None]


@pytest.mark.parametrize("linked", [False, True])
@pytest.mark.parametrize("p", [Params(k=14, score=30), Params(k=14, score=90, repeat=1), Params(k=9, score=60, gapless=-1), Params(k=17, score=30, ge=0, gi=3, xdrop=20)])
def test_screened_reads_align_as_all_seeds_do(spark, texts, queries, linked, p, monkeypatch):
    """Both ways to seeds give the same results; ``filters`` takes the joins."""
    segs = spark.createDataFrame([(f"s{i}", s, i) for i, s in enumerate(texts)], "name string, seq string, o long")
    links = spark.createDataFrame([("s0", 0, "s1", 0, 10), ("s0", 0, "s3", 1, 11), ("s3", 1, "s1", 0, 12), ("s2", 0, "s5", 1, 13)], "src string, src_ori int, dst string, dst_ori int, o long")
    ref = G.build(segs, links, "o") if linked else G.build(segs, order="o")
    reads = spark.createDataFrame(list(enumerate(queries)), "read_ord long, seq string")
    want = results(M.align(ref, reads, p, filters=lambda seeds: seeds))
    assert want and results(M.align(ref, reads, p)) == want
    monkeypatch.setattr(M, "MOST_INDEXED", 100)
    assert results(M.align(ref, reads, p)) == want


def test_reads_in_slices(texts, monkeypatch):
    import pyarrow as pa

    own = [None, "", *texts, texts[0] + "é" + texts[1], ""]
    batch = pa.RecordBatch.from_pydict({"read_ord": list(range(len(own))), "seq": own})
    monkeypatch.setattr(S, "LETTERS", 300)
    parts = list(S.slices(batch))
    assert len(parts) > 3 and [i for ids, *_ in parts for i in ids.to_pylist()] == list(range(len(own)))
    for _, read, text, ends in parts:
        assert text.tobytes() == b"".join(read) and ends.tolist() == np.cumsum([len(t) for t in read]).tolist()
    assert [len(t) for _, read, *_ in parts for t in read] == [len(t or "") for t in own]


def test_reads_are_not_listed_as_windows(spark, texts):
    """Seeds are found where reads are read: no join of k-mers, and only reads with a seed that can pass are dealt out."""
    ref = G.build(spark.createDataFrame([(f"s{i}", s, i) for i, s in enumerate(texts)], "name string, seq string, o long"), order="o")
    noise = [dna(300) + texts[0][50:70] + dna(300) for _ in range(200)]
    reads = spark.createDataFrame(list(enumerate([*noise, texts[0]])), "read_ord long, seq string")
    found = M.align(ref, reads, Params(k=14))
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert [r["read_ord"] for r in found.select("read_ord").distinct().collect()] == [200]
    index = M._index(ref, M._load(ref), 10_000, Params(k=14).resolved())
    dealt = reads.mapInArrow(lambda batches: S.found(index, batches, Params(k=14).resolved()), f"qid long, {S.SEEDS}")
    assert [r["qid"] for r in dealt.collect()] == [200]


def test_reads_without_a_number_and_repeated_ones(spark, texts):
    ref = G.build(spark.createDataFrame([(f"s{i}", s, i) for i, s in enumerate(texts)], "name string, seq string, o long"), order="o")
    reads = spark.createDataFrame([(None, texts[0]), (7, texts[0]), (7, texts[0])], "read_ord long, seq string")
    rows = M.align(ref, reads, Params(k=14)).groupBy("read_ord", "score").agg(F.count("*").alias("n")).collect()
    assert sorted((r["read_ord"] or 0, r["score"], r["n"]) for r in rows) == [(0, 400, 1), (7, 400, 2)]
