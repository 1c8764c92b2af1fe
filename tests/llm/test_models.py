import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.llm import language, quality, toxicity

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# language


def naive_bundle(text, letters):
    """Bound and bundled trigrams, letter by letter."""
    out, classes = np.zeros(language.DIM), []
    for c in text.lower():
        k = int(letters.table[ord(c)])
        if k or (classes and classes[-1]):
            classes.append(k)
    while classes and classes[-1] == 0:
        classes.pop()
    if classes:
        classes = [0, *classes, 0]
    v = letters.vectors.astype(np.int64)
    for a, b, c in zip(classes, classes[1:], classes[2:]):
        out += np.roll(np.roll(v[a], 1), 1) * np.roll(v[b], 1) * v[c]
    return out


def test_bundles_equal_letter_by_letter():
    letters = language.Letters()
    texts = ["The cat", "a", "", "123 !", "  Über--straße 中文 x ", "ab1cd", "é" * 50, "Ω я"]
    got = {}
    for at, v in letters.bundles(texts):
        got.update(zip(at, v))
    for i, t in enumerate(texts):
        want = naive_bundle(t, letters)
        assert (i in got) == bool(want.any() or any(c.isalpha() for c in t))
        if i in got:
            assert np.abs(got[i] - want).max() < 1e-3, t


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(docs, rows, empty, spark):
    out = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        assert (out[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t
        assert out[i]["lang_pred"] in ("und", "en", "fr") and 0 <= out[i]["score"] <= 1
    assert language.identify(empty).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(none).collect()} == {"und"}
    kept = language.keep_identified(docs)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()


def test_keeping_identified_texts(spark):
    """Thresholds by plain quantiles; texts of another language go, clean ones of any length stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    g = random.Random(2)
    other = [" ".join("".join(g.choice("qxzwjvkpyg") for _ in range(7)) for _ in range(n)) for n in (150, 300, 900)]
    strange = spark.createDataFrame([(10**7 + i, t, "en" if i % 2 else None) for i, t in enumerate([*other, "123 456", None])], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(strange)
    kept = {r["doc_id"] for r in language.keep_identified(both).collect()}
    assert not kept & {10**7 + i for i in (0, 2, 3, 4)}  # 1 may itself have been learned from
    rows = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("quality = 1").collect()
    assert np.mean([r["doc_id"] in kept for r in rows]) > 0.99
    train = docs.filter(~F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"))
    make = language._predictor(*language.prototypes(train))
    least = language.thresholds(train, make)
    by_size = {}
    for r in train.filter("text is not null and lang is not null").collect():
        (lang,), (score,) = make()([r["text"]])
        if lang == r["lang"]:
            by_size.setdefault(len(r["text"]).bit_length(), []).append(score)
    for size, scores in by_size.items():
        assert least[size] == pytest.approx(language.MARGIN * sorted(scores)[max(0, int(np.ceil(language.QUANTILE * len(scores))) - 1)], abs=1e-6)


# quality


def base(t):
    words = [w for w in (t or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = set()
    for i in range(len(words) - 4):
        if runs[tuple(words[i : i + 5])] > 1:
            marked |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(marked)


def test_base_rules(rows):
    g = random.Random(3)
    texts = [t for _, t in rows] + [" ".join(g.choice("ab") for _ in range(g.randrange(40))) + "\n" * g.randrange(3) + "x#|\nx#|\n \n \n" for _ in range(300)]
    for t in texts:
        assert quality.base_rules(t or "") == base(t), t


def test_rates_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    raw, target = Counter(), Counter()

    def grams(t):
        out = []
        for order in quality.ORDERS:
            for i in range(len(t) - order + 1):
                h = order
                for c in t[i : i + order]:
                    h = ((h ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                out.append(h >> 16)
        return out

    some = {i: grams(t) for i, t in list(texts.items())[:40]}
    for i, g in some.items():
        assert sorted(quality.ngrams(texts[i]).tolist()) == sorted(g)
    for i, t in texts.items():
        g = quality.ngrams(t).tolist()
        raw.update(g)
        if marks.get(i) == 1:
            target.update(g)
    ratio, threshold = quality.fit(docs, labels)
    n, m = sum(raw.values()), sum(target.values())
    for b in list(raw)[:500]:
        want = np.log((target[b] + 0.5) / (m + 0.5 * quality.BUCKETS)) - np.log((raw[b] + 0.5) / (n + 0.5 * quality.BUCKETS))
        assert ratio[b] == pytest.approx(want)
    out = {r["doc_id"]: r for r in quality.rate(docs, labels).collect()}
    for i, t in texts.items():
        b, s = base(t), quality.score(t, ratio)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == failed and r["kept"] == (not failed and s >= threshold) and r["llr"] == pytest.approx(s)
    good = [out[i]["kept"] for i, q in marks.items() if q == 1 and i in out and not out[i]["base_failed"]]
    assert np.mean(good) > 0.99


def test_quality_odd_rows(docs, rows, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.rate(docs, labels).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        assert (out[i]["n_words"], out[i]["n_repeat_words"]) == (base(t)[0], base(t)[4])
    none = labels.limit(0)
    assert {r["kept"] == (not r["base_failed"]) for r in quality.rate(docs, none).collect()} == {True}
    assert quality.rate(empty, none).count() == 0 and quality.keep_good(empty, labels).count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.schema == docs.schema and kept.count() == sum(not r["base_failed"] for r in out.values())


def test_every_trusted_row_counts(spark):
    """Counts and threshold are those of all trusted rows, however many; others' texts count for the corpus alone."""
    n = 20_300
    docs = spark.range(2 * n).selectExpr("id as doc_id", "concat(sha2(cast(id as string), 256), if(id % 7 = 0, 'zz!', '')) as text")
    labels = spark.range(n).selectExpr("2 * id as doc_id", "1 as quality").unionAll(spark.createDataFrame([(1, 0), (3, None), (None, 1)], "doc_id long, quality int"))
    ratio, threshold = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    raw, target = (np.bincount(np.concatenate([quality.ngrams(t) for i, t in texts.items() if i % step == 0]), minlength=quality.BUCKETS) for step in (1, 2))
    want = np.log((target + 0.5) / (target.sum() + 0.5 * quality.BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * quality.BUCKETS))
    assert np.allclose(ratio, want, rtol=0, atol=1e-12)
    own = sorted(quality.score(t, ratio) for i, t in texts.items() if i % 2 == 0)
    assert threshold == own[int(np.ceil(quality.QUANTILE * n)) - 1] - quality.MARGIN


def test_quantiles_are_exact(spark):
    g = np.random.default_rng(5)
    for values in (g.normal(size=300_000), g.integers(0, 40, 30_000) / 8, np.ones(5), np.array([3.0, -1.0])):
        rows = spark.createDataFrame(pd.DataFrame({"score": values})).repartition(5).persist()
        for share in (0.001, 0.0305, 0.5, 1.0):
            assert quality.quantile(rows, share) == np.sort(values)[int(np.ceil(share * len(values))) - 1]
    assert quality.quantile(rows.limit(0), 0.001) is None


# toxicity


def toxic_rows(seed, n):
    g = random.Random(seed)
    common = ["".join(g.choice("abcdefgh") for _ in range(g.randrange(2, 8))) for _ in range(400)]
    bad = ["zorgish", "zorgful", "krultak", "krultod", "vexmor"]
    out = []
    for _ in range(n):
        w = [g.choice(common) for _ in range(g.randrange(5, 150))]
        y = int(g.random() < 0.4)
        for _ in range(g.randrange(1, 4) * y):
            w.insert(g.randrange(len(w)), g.choice(bad))
        out.append((" ".join(w), y))
    return out


def test_gradients():
    net, g = toxicity.Network(seed=1), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, index = ["alpha", "beta", "gamma", "delta"], np.array([[0, 1, 2, -1], [3, 3, -1, -1], [1, 0, 3, 2]])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        logit = net.forward(net.gates(net.inputs(words)[0]), index)[0]
        return float(np.mean(np.log1p(np.exp(-logit)) * y + np.log1p(np.exp(logit)) * (1 - y)))

    grad = net.learn(words, index, y)
    for name, v in net.p.items():
        flat = np.flatnonzero(grad[name]) if name in ("word", "char") else np.arange(v.size)
        for k in g.choice(flat, min(6, len(flat)), replace=False):
            at = np.unravel_index(k, v.shape)
            keep = v[at]
            v[at] = keep + 1e-4
            up = loss()
            v[at] = keep - 1e-4
            down = loss()
            v[at] = keep
            assert grad[name][at] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=2e-5), name


def plain_logit(p, inputs):
    """One window, word by word: two recurrences, attention, a logistic unit."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, seen = toxicity.HIDDEN, []
    for way, order in ((0, range(len(inputs))), (1, range(len(inputs) - 1, -1, -1))):
        state, own = np.zeros(h), {}
        for t in order:
            g = inputs[t] @ p["wx"][way] + p["bx"][way][0]
            u = state @ p["wh"][way]
            z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
            own[t] = state
        seen.append(own)
    states = [np.concatenate([seen[0][t], seen[1][t]]) for t in range(len(inputs))]
    e = np.array([np.tanh(s @ p["wa"] + p["ba"]) @ p["va"] for s in states])
    a = np.exp(e - e.max())
    return sum(w * s for w, s in zip(a / a.sum(), states)) @ p["wo"] + p["bo"][0]


def test_forward_against_word_by_word():
    net = toxicity.Network(seed=4)
    g = np.random.default_rng(5)
    net.p = {k: v.astype(np.float64) + 0.1 * g.standard_normal(v.shape) for k, v in net.p.items()}
    text = " ".join(g.choice(["alpha", "beta", "gamma", "delta", "épsilon", "中文"], 75))
    words = toxicity.words_of(text)
    x = net.inputs(words)[0]
    want = []
    for lo in range(0, 75 - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE):
        want.append(plain_logit(net.p, x[lo : lo + toxicity.WINDOW]))
    got = net.forward(net.gates(x), toxicity.window_index(75))[0]
    assert got == pytest.approx(want, abs=1e-5) and toxicity.Scorer(net.p).logits([text])[0] == pytest.approx(want, abs=1e-4)


def test_inputs_of_a_word():
    net = toxicity.Network(seed=1)
    x, (w, c, at, n) = net.inputs(["abcd", "x"])
    assert n[:, 0].tolist() == [4, 1] and at.tolist() == [0, 4]  # <ab abc bcd cd>, <x>
    assert x[0, toxicity.EMBED :] == pytest.approx(net.p["char"][c[:4]].mean(0)) and x[1, : toxicity.EMBED] == pytest.approx(net.p["word"][w[1]])


def test_runs_without_blanks_are_read_whole():
    net = toxicity.Scorer(toxicity.Network(seed=2).p)
    a, b = net.scores(["x" * 64 + "kill", "x" * 64 + "love"])
    assert a != b
    for n in (63, 64, 65, 97, 1000):
        w = "".join(chr(0x4E00 + i) for i in range(n))
        parts = toxicity.words_of(f"a {w} b")
        assert parts[0] == "a" and parts[-1] == "b" and max(map(len, parts)) <= 64
        assert all(any(w[i : i + 32] in p for p in parts) for i in range(max(1, n - 31)))


def test_repeated_ids_are_sampled_alike(spark):
    rows = [(1, "bad text"), (1, "a bad text"), (2, "fine"), (1, None), (2, "fine"), (None, "none"), (3, "")]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for k in range(3):
        df = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string").repartition(2 + k)
        assert sorted(zip(*toxicity.sample(df.filter("text is not null"), labels))) == [("bad text", 1), ("fine", 0)]


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        index = toxicity.window_index(n)
        assert set(index[index >= 0].tolist()) == set(range(n))
        assert len(index) == 1 or (index[1:, 0] - index[:-1, 0] == toxicity.STRIDE).all()


@pytest.fixture(scope="module")
def trained():
    rows = toxic_rows(1, 500)
    return toxicity.train([t for t, _ in rows], [y for _, y in rows])


def test_learns_and_generalises(trained):
    rows = toxic_rows(2, 300)
    s = toxicity.Scorer(trained).scores([t for t, _ in rows])
    y = np.array([y for _, y in rows])
    assert ((s >= 0.5) == y).mean() > 0.95


def test_scores_do_not_depend_on_the_batch(trained):
    texts = [t for t, _ in toxic_rows(3, 40)] + ["", "x" * 9000, " ".join(["zorgish"] * 5000)]
    together = toxicity.Scorer(trained).scores(texts)
    alone = np.concatenate([toxicity.Scorer(trained).scores([t]) for t in texts])
    assert np.abs(together - alone).max() < 1e-5


def test_one_toxic_window_decides(trained):
    plain = " ".join(t for t, y in toxic_rows(4, 60) if not y)
    s = toxicity.Scorer(trained).scores([plain, plain + " zorgish krultak " + plain])
    assert s[1] > 0.5 > s[0]


def test_toxicity_odd_rows(docs, rows, empty, spark):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.rate(docs, labels).collect()
    assert sorted(r["doc_id"] for r in out) == [i for i, _ in rows]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in out)
    assert toxicity.rate(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.rate(docs, labels.limit(0)).collect()} == {0.0}


def test_held_out_rows_teach_nothing(docs, rows, spark):
    held = [i for i, _ in rows if fold(i, 5) == 0]
    labels = spark.createDataFrame([(i, 1, 1) for i in held], "doc_id long, quality int, toxic int")
    assert toxicity.sample(docs, labels) == ([], [])
