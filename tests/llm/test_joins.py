import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import neardup, ngramjoin
from helixframe.llm.components import components


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(links, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    lists = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    links = []
    for i, s in sets.items():
        for j, k in Counter(j for g in s for j in lists[g] if j > i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                links.append((i, j))
    return {i: (len(sets[i]), c) for i, c in groups(links, sets).items()}


def near_rows(seed, n_groups=12, hot=60):
    g = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    passage = [g.choice(vocab) for _ in range(40)]
    rows = []
    for _ in range(n_groups):
        base = [g.choice(vocab) for _ in range(g.randrange(1, 250))]
        for _ in range(g.randrange(1, 12)):
            w = list(base)
            for _ in range(g.randrange(0, max(1, len(w) // 30) + 1)):
                w[g.randrange(len(w))] = g.choice(vocab)
            if g.random() < 0.4:
                w = w[: max(1, int(len(w) * g.uniform(0.75, 1)))]
            if g.random() < 0.3:
                at = g.randrange(len(w) + 1)
                w = w[:at] + passage + w[at:]
            rows.append(" ".join(w))
    base = [g.choice(vocab) for _ in range(120)]
    for _ in range(hot):  # one large group about the threshold
        w = list(base)
        for _ in range(g.randrange(0, 4)):
            w[g.randrange(len(w))] = g.choice(vocab)
        rows.append(" ".join(w))
    rows += [" ".join(passage)] * 5 + [" ".join(passage[:k]) for k in range(1, 9)]
    g.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(ngramjoin, "TILE", 16)  # many tiles a shard
    rows = near_rows(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(df).collect()}
    assert got == brute(rows)


def test_ngram_join_on_odd_rows(docs, rows, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(docs).collect()}
    assert got == brute(rows)
    assert ngramjoin.join(empty).count() == 0


def test_ngram_join_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A  B\tc d e f"), (4, None), (5, "")]
    got = sorted(map(tuple, ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (9, 2, 3), (4, 0, 4), (5, 0, 5)], key=str)
    kept = ngramjoin.keep_one(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, component_id string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "3", "4", "5", "None"]


def test_sets_whose_digests_begin_alike_link(spark):
    """The digests of the first two texts share 32 bits."""
    words = [f"w{i}" for i in range(59)]
    rows = [(i, " ".join([*words, last])) for i, last in enumerate(("v50627", "v90427", "v999999991"), 1)]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_frequent_lists_are_split(spark):
    """One list that many sets share is dealt in parts, and none of its links is lost."""
    g = random.Random(8)
    base = [f"b{k}" for k in range(60)]
    rows = [(i, " ".join(base[: g.randrange(52, 61)] + [f"x{i}"])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    level = ngramjoin.levels(ngramjoin.profile(df).filter("not is_doc"))
    listed = ngramjoin.prefixes(df, level).collect()
    assert max(r["level"] for r in listed) >= 3
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(df).collect()}
    assert got == brute(rows)


def test_search_against_brute_force():
    g = np.random.default_rng(3)
    for _ in range(60):
        pool = g.integers(0, 1 << 60, 90).astype(np.uint64)
        sets = [np.unique(g.choice(pool, g.integers(1, 80), replace=False)) for _ in range(12)]
        sets += [np.unique(np.concatenate([sets[0][: g.integers(1, len(sets[0]) + 1)], g.choice(pool, 3)])) for _ in range(6)]
        tile = ngramjoin.Tile(sets)
        possible = ngramjoin.possible(tile.sizes, [ngramjoin.histogram(s) for s in sets], np.ones(len(sets), bool))
        for q in range(len(sets)):
            among = np.arange(len(sets)) != q
            want = [c for c in np.flatnonzero(among) if ngramjoin.linked(len(np.intersect1d(sets[q], sets[c])), len(sets[q]), len(sets[c]))]
            assert tile.search(q, among).tolist() == want
            assert not want or possible[q]


def test_words_hash_alike_in_any_chunk(monkeypatch):
    text = " ".join(f"Word{i % 37}x{i}" for i in range(3000)) + " " + "y" * 9000 + " é 中 😀"
    whole = ngramjoin.Shingler().set(text)
    monkeypatch.setattr(ngramjoin, "_CHUNK", 100)
    assert (ngramjoin.Shingler().set(text) == whole).all() and len(whole) == len(shingles(text))


def test_components(spark):
    g = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(300, 400)] + [(g.randrange(60), g.randrange(60)) for _ in range(30)] + [(7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == groups(real, {x for ab in real for x in ab})
    assert components(df.limit(0)).count() == 0


def vectors(seed):
    g = np.random.default_rng(seed)
    out = [g.standard_normal(64) for _ in range(300)]
    for _ in range(25):
        c = g.standard_normal(64)
        out += [c + 0.2 * g.standard_normal(64) for _ in range(g.integers(2, 12))]
    c = g.standard_normal(64)
    out += [c + 0.15 * g.standard_normal(64) for _ in range(150)]
    out += [c * 1.0 for _ in range(40)]
    g.shuffle(out)
    return np.array(out, np.float32)


@pytest.mark.parametrize("small", [False, True])
def test_neardup_recall(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(neardup, "BLOCK", 96)
        monkeypatch.setattr(neardup, "HALO", 32)
        monkeypatch.setattr(neardup, "TILE", 20)
    x = vectors(2)
    df = spark.createDataFrame([(i, v.tolist(), 0, "c") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    got = {r["vec_id"]: r for r in neardup.deduplicate(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = groups(list(zip(*np.nonzero(near))), range(len(x)))
    links = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= near[i].sum() for i in got)
    assert links >= (0.9 if small else 1.0) * near.sum()
    assert all(want[i] == want[got[i]["component_id"]] and got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    if not small:
        assert {i: r["component_id"] for i, r in got.items()} == want


def test_neardup_recall_with_many_rows_a_block(spark, monkeypatch):
    """Windows far smaller than the table: the passes grow until pairs at the threshold have met."""
    monkeypatch.setattr(neardup, "BLOCK", 12)
    monkeypatch.setattr(neardup, "HALO", 4)
    g = np.random.default_rng(4)
    x = g.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3000:3400] = neardup.partners(x[:400], 0.9005)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    kept = {r["vec_id"]: r["component_id"] for r in neardup.deduplicate(df).collect()}
    assert np.mean([kept[3000 + i] == i for i in range(400)]) > 0.96


def test_neardup_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [2.0, 0.0]), (10, [-1.0, 0.0]), (11, [3e38, 1e38])]
    got = [tuple(r) for r in neardup.deduplicate(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    # rows 0, 1 (twice), 2 and 11 point one way
    want = [(0, 4, 0, True), (1, 4, 0, False), (1, 4, 0, False), (2, 4, 0, False), (11, 4, 0, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)] + [(None, 0, None, None)]
    assert sorted(got, key=str) == sorted(want + alone, key=str)
    assert neardup.deduplicate(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
