import random

import pytest

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sha", "lo", "pen") for b in ("ran", "tel", "vo", "kis", "dum", "a", "")]


def prose(g, n):
    return " ".join(g.choice(WORDS) + g.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=7, n=60):
    """Rows ``(doc_id, text)``: prose, copies, near copies, junk, null, empty, one long text."""
    g = random.Random(seed)
    texts = [prose(g, g.randrange(1, 160)) for _ in range(n)]
    texts += [texts[3]] * 6 + [texts[4] + " tail"] * 2
    words = texts[5].split()
    for _ in range(8):
        w = list(words)
        for _ in range(max(1, len(w) // 60)):
            w[g.randrange(len(w))] = "swap"
        texts.append(" ".join(w))
    texts += [None, "", " \t\n ", "one", "One two", "ÀÉ 中文字 ﬁ ß İ", "a" * 5000, prose(g, 6000), "\x00\x1f odd   blanks\x85 \xa0here", "x 😀 y " * 30, "don't we'll 'tis '' 's\n\n\n  three   blanks \n"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names clash with what operators return."""
    langs = ["en", "fr", None]
    full = [(i, t, langs[i % 3], "s", 1.5, "keep", True) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, score double, component_id string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
