import random

from pyspark.sql import functions as F

from helixframe.operators import intervals as I
from helixframe.operators import ordering as O
from helixframe.operators import seeds as S

SPANS = [(100, 200), (50, 100), (120, 180), (60, 240), (70, 200), (100, 140), (90, 150), (110, 160), (120, 140), (40, 190)]


def iv(spark, l, r, kind, width=64):
    a = spark.createDataFrame(SPANS, "lkey long, rkey long")
    return sorted((x["lkey"], x["rkey"]) for x in kind(a, spark.createDataFrame([(l, r)], "l long, r long"), width).collect())


def test_interval_joins(spark):
    assert iv(spark, 100, 170, I.contained) == [(100, 140), (110, 160), (120, 140)]
    assert iv(spark, 100, 150, I.containing) == [(40, 190), (60, 240), (70, 200), (90, 150), (100, 200)]
    want = [(40, 190), (60, 240), (70, 200), (90, 150), (100, 140), (100, 200), (110, 160)]
    assert iv(spark, 100, 120, I.intersect) == want
    assert iv(spark, 100, 120, I.intersect, 7) == want


def test_interval_joins_against_brute_force(spark):
    g = random.Random(1)
    a = [(x, x + g.randrange(0, 60)) for x in (g.randrange(-50, 200) for _ in range(120))]
    q = [(i, x, x + g.randrange(0, 50)) for i, x in enumerate(g.randrange(-50, 200) for _ in range(30))]
    da, dq = spark.createDataFrame(a, "lkey long, rkey long"), spark.createDataFrame(q, "i int, l long, r long")
    tests = {I.contained: lambda x, y, l, r: l <= x < r and y < r, I.containing: lambda x, y, l, r: x <= l and y >= r, I.intersect: lambda x, y, l, r: x < r and y > l}
    for kind, test in tests.items():
        got = sorted((r["i"], r["lkey"], r["rkey"]) for r in kind(da, dq, 13).collect())
        assert got == sorted((i, x, y) for x, y in a for i, l, r in q if test(x, y, l, r)), kind


def test_nearest(spark):
    keys = spark.createDataFrame([("g", 2 * i) for i in range(256)], "u string, key long")
    probes = spark.createDataFrame([("g", 65, 1), ("g", 31, 2), ("g", 64, 3), ("g", -5, 4), ("g", 900, 5), ("h", 10, 6)], "u string, key long, id int")
    left = {r["id"]: r["found"] for r in I.nearest(keys, probes, ["u"]).collect()}
    right = {r["id"]: r["found"] for r in I.nearest(keys, probes, ["u"], left=False).collect()}
    assert left == {1: 64, 2: 30, 3: 64, 4: None, 5: 510, 6: None}
    assert right == {1: 66, 2: 32, 3: 64, 4: 0, 5: None, 6: None}
    assert [r["id"] for r in I.exact(keys, probes, ["u"]).collect()] == [3]


def test_nearest_of_a_large_group_against_brute_force(spark):
    g = random.Random(6)
    keys = [(g.choice("aaaab"), g.randrange(2000)) for _ in range(300)]
    probes = [(g.choice("aaaabc"), g.randrange(-50, 2050), i) for i in range(400)]
    dk, dp = spark.createDataFrame(keys, "u string, key long"), spark.createDataFrame(probes, "u string, key long, id int")
    for left in (True, False):
        got = {r["id"]: r["found"] for r in I.nearest(dk, dp, ["u"], left, parts=7).collect()}
        for u, k, i in probes:
            fit = [x for v, x in keys if v == u and (x <= k if left else x >= k)]
            assert got[i] == ((max(fit) if left else min(fit)) if fit else None)


def test_sorts_and_numbers(spark):
    g = random.Random(2)
    rows = [(i, g.randrange(1 << 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "p int, k long")
    assert [r["k"] for r in O.sort_full(df, "k").collect()] == sorted(k for _, k in rows)
    assert [r["p"] for r in O.sort_half(df, "k", "p", 8).collect()] == [p for p, k in sorted(rows, key=lambda x: (x[1] & 255, x[0]))]
    assert [r["p"] for r in O.sort_partial(df, "k", "p", 1, 3).collect()] == [p for p, k in sorted(rows, key=lambda x: (x[1] >> 8 & 65535, x[0]))]
    assert [r["k"] for r in O.smallest(df, 5, "k").collect()] == sorted(k for _, k in rows)[:5]
    order = {r["p"]: r["n"] for r in O.numbered(df, "k", "p").collect()}
    assert [p for p, _ in sorted(order.items(), key=lambda x: x[1])] == [p for p, k in sorted(rows, key=lambda x: (x[1], x[0]))]
    assert sorted(order.values()) == list(range(500))
    assert O.numbered(df.limit(0), "k", "p").count() == 0


def test_window_operators(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, -5), ("a", 3, 4), ("a", 4, -4), ("b", 1, 1)], "g string, o int, v int")
    assert {(r["g"], r["at"], r["least"]) for r in O.prefix_argmin(df, ["g"], "o", F.col("v")).collect()} == {("a", 2, -2), ("b", 1, 1)}
    assert {(r["g"], r["o"], r["offset"]) for r in O.offsets(df, ["g"], "o", F.col("v")).collect()} == {("a", 1, 0), ("a", 2, 3), ("a", 3, -2), ("a", 4, 2), ("b", 1, 0)}
    assert {(r["g"], r["o"]) for r in O.running_best(df, ["g"], "o", "v").collect()} == {("a", 1), ("a", 3), ("b", 1)}
    assert {(r["g"], r["o"], r["prev"], r["next"], r["primary"]) for r in O.linked(df.filter("g = 'a' and o < 3"), ["g"], "o").collect()} == {("a", 1, None, 2, True), ("a", 2, 1, None, False)}
    res = spark.createDataFrame([(1, 0, 9), (1, 1, 9), (1, 2, 7), (2, 0, 5)], "read_id int, ordinal int, score int")
    assert {(r["read_id"], r["ordinal"]) for r in O.distinct_scores(res).collect()} == {(1, 0), (1, 1), (2, 0)}


def test_histogram(spark):
    rows = O.histogram(spark.range(1000), F.col("id"), 256).collect()
    n = {b: len(range(b, 1000, 256)) for b in range(256)}
    assert {r["bin"]: r["n"] for r in rows} == n
    assert all(r["start"] == sum(n[b] for b in range(r["bin"])) for r in rows)


def brute(ref, query, k, repeat):
    flip = str.maketrans("ACGT", "TGCA")
    place = {}
    for rid, s in ref:
        for d, t in ((0, s), (1, s.translate(flip)[::-1])):
            for i in range(len(t) - k + 1):
                if "N" not in t[i : i + k]:
                    place.setdefault(t[i : i + k], set()).add((rid, d, i))
    out, every = set(), set()
    for qid, s in query:
        prev = None
        for i in range(len(s) - k + 1):
            hits = place.get(s[i : i + k], set())
            if not hits or len(hits) > repeat:
                prev = None
                continue
            every |= {(qid, i, *h) for h in hits}
            out |= {(qid, i, *h) for h in hits if prev is None or (h[0], h[1], h[2] - 1) not in prev}
            prev = hits
    return every, out


def test_seeds_against_brute_force(spark):
    g = random.Random(4)
    ref = [(i, "".join(g.choice("ACGT") for _ in range(150))) for i in range(3)] + [(3, "ACGT" * 12 + "N" + "A" * 20)]
    query = [(10, ref[0][1][20:90]), (11, ref[1][1][10:60] + "T" + ref[1][1][60:100]), (12, "A" * 12 + "N" * 3 + "ACGTAC"), (13, "")]
    dr, dq = spark.createDataFrame(ref, "i int, s string"), spark.createDataFrame(query, "i int, s string")
    rk, qk = S.reference_kmers(dr, "i", "s", 5), S.query_kmers(dq, "i", "s", 5)
    every, kept = brute(ref, query, 5, 12)
    seeds = S.seed_join(rk, qk, 12)
    as_set = lambda df: {(r["qid"], r["qpos"], r["rid"], r["dir"], r["rpos"]) for r in df.collect()}
    assert as_set(seeds) == every
    known = qk.join(S.counted_hits(rk, qk).filter("hits <= 12"), "kmer").select("qid", "qpos")
    assert as_set(S.drop_adjacent(seeds, known)) == kept
    runs = S.chains(seeds).collect()
    assert sum(r["n"] for r in runs) == len(every)
    assert all(r["end"] - r["start"] + 1 == r["n"] for r in runs)
    assert all(r["hits"] > 12 for r in S.repetitive(rk, qk, 12).collect())
