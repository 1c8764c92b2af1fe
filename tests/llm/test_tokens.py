import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import bpe, packing, tokenfile, tokens

WORD, BYTE, MULTI = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json"), public.path("byte_bpe_multi_50k.tiktoken")


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,blanks", [(WORD, False), (BYTE, True)])
def test_pieces_equal_the_library(path, blanks):
    enc, plain, g = tokens.Encoder(path, blanks), library(path), random.Random(2)
    alphabet = " \t\n\r  ab'1é!sS._´<|endoftext|>Σσς́İ中ﬁµªº²Ɏ\x00\x1f\xa0"
    for _ in range(6000):
        s = "".join(g.choice(alphabet) for _ in range(g.randrange(14)))
        assert np.frombuffer(enc.one(s), enc.kind).tolist() == plain(s), repr(s)


def test_table_is_bounded():
    made = []
    t = tokens.Recent(3, lambda k: made.append(k) or k.encode())
    for k in "abcabcdabce":
        assert t[k] == k.encode()
    assert len(t) <= 3 and len(t.old) <= 3
    t["x" * 1000]
    assert "x" * 1000 not in t


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(MULTI, public.PATTERN)


@pytest.fixture(scope="module")
def official(codec):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_equals_the_library(codec, official, rows):
    g = random.Random(1)
    texts = [t for _, t in rows if t] + ["a" * 30_000, "".join(g.choice("abcdefg") for _ in range(30_000)), "中" * 5000, "é" * 999 + "😀" * 77]
    texts += ["".join(g.choice(" \t\nab'1é!sS中😀\xa0　") for _ in range(g.randrange(20))) for _ in range(3000)]
    for t in texts:
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == official.encode_ordinary(t)
        assert codec.decode(packed) == t.encode()


def test_every_character_is_split_as_in_the_library(codec, official):
    """Each code point beside a letter, a number, a blank, a mark and its like; newer ones than the library knows included."""
    newer = sorted(bpe.newer_characters())
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    for step in (every[:0x3100:3], every[0x3100::97], newer):
        for c in map(chr, step):
            t = f"a{c}b 1{c}2 {c}  {c}{c}! {c}'s"
            assert np.frombuffer(codec.encode(t), "<u4").tolist() == official.encode_ordinary(t), hex(ord(c))
    t = "".join(map(chr, newer)) * 2
    assert codec.decode(codec.encode(t)) == t.encode()


def test_rank_queue():
    g, q, want = random.Random(4), bpe.RankQueue(50_256), defaultdict(list)
    for _ in range(500):
        r, p = g.randrange(50_256), g.randrange(100)
        q.push(r, p)
        want[r].append(p)
        if g.random() < 0.4:
            least = min(want)
            assert q.pop() == (least, want.pop(least))
    while want:
        least = min(want)
        assert q.pop() == (least, want.pop(least))
    assert q.top == 0 and not any(q.low) and not any(q.mid)


def test_bpe_query(docs, rows, official):
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, MULTI, public.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = np.array(official.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["same"]


def test_variable_bytes():
    g = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000, 70_003):
        v = (g.integers(0, 1 << 32, n) >> g.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenfile.encode(v)
        assert len(control) == -(-n // 4)
        assert (tokenfile.decode(control, data, n) == v).all()


def test_token_files(docs, rows, spark):
    plain = library(BYTE)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.round_trip(docs, BYTE).collect())
    want, at = [], 0
    for i, t in rows:
        ids = np.array([*plain(t), 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_hold_ids_repeats_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(5, "b b"), (None, "x"), (5, "b b"), (1, None), (5, "a longer text")], "doc_id long, text string").repartition(3)
    files = tokenfile.write(df, BYTE, f"file://{tmp_path}/out")
    out = tokenfile.read(spark, f"file://{tmp_path}/out", files).orderBy("start").collect()
    plain = library(BYTE)
    assert [r["doc_id"] for r in out] == [None, 1, 5, 5, 5]
    assert [list(r["ids"]) for r in out] == [[*plain(t), 0] for t in ("x", "", "b b", "b b", "a longer text")]
    assert sorted(p.name for p in (tmp_path / "out").iterdir())[-1] == "ranks"


def test_token_files_of_nothing(empty):
    assert tokenfile.round_trip(empty, BYTE).count() == 0


def check_packing(rows, out, window, end):
    plain = library(WORD)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    padding = 0
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    for i, t in rows:
        ids, at = np.array([*plain(t), end], "<u4"), 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            if "ids" in r.asDict():
                assert list(r["ids"]) == ids[at : at + r["length"]].tolist()
            at += r["length"]
        assert at == len(ids)
    return padding


@pytest.mark.parametrize("window", [4096, 64, 7])
def test_packing(docs, rows, window):
    assert check_packing(rows, packing.pack(docs, WORD, window).collect(), window, 2) == 0


def test_token_files_with_odd_ids(spark):
    """Null ids, the least id of all, repeated rows, and columns named like results."""
    rows = [(None, "none", 1), (-(1 << 63), "least", 2), (5, "five", 3), (5, "five", 3), (5, "cinq cinq", 4), (None, None, 5)]
    out = tokenfile.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3), BYTE).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, None, -(1 << 63), 5, 5, 5]
    plain = library(BYTE)
    assert sorted(r["n_tokens"] for r in out) == sorted(len(plain(t or "")) + 1 for _, t, _ in rows)


def test_packing_of_nothing(empty):
    assert packing.pack(empty, WORD).count() == 0


def test_place_makes_the_sum_of_squares_least():
    g = random.Random(8)
    p = packing.Packer(32, max_open=10_000)
    for step in range(2000):
        size = g.randrange(1, 32)
        n = p.level.copy()

        def cost(h):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 32:
                m[h + size] += 1
            return int((m[1:32] ** 2).sum())

        options = {h: cost(h) for h in range(33 - size) if h == 0 or n[h]}
        assert cost(p.place(size)) == min(options.values())
        p.add((step, size), np.zeros(size, "<u4").tobytes())


def test_open_windows_are_bounded():
    g, p, closed = random.Random(9), packing.Packer(4096, max_open=20), 0
    sizes = [g.randrange(1, 4096) for _ in range(3000)]
    for i, n in enumerate(sizes):
        closed += sum(len(x) for s in p.add((i, n), bytes(4 * n)) for x in s)
        assert p.count <= 21
    closed += sum(len(x) for s in p.settle() for x in s)
    assert closed == sum(sizes)


def test_repeated_rows_are_packed_repeatedly(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "none")], "doc_id long, text string")
    out = packing.pack(df, WORD).select(F.sum("length").alias("n")).first()["n"]
    plain = library(WORD)
    assert out == 2 * (len(plain("same text")) + 1) + len(plain("none")) + 1


@pytest.mark.parametrize("step", [1, 7, 400])
def test_texts_encoded_at_once_equal_the_library(step):
    """Cut over the bytes of many texts: white space at their ends, marks and blanks in a row, letters and signs of two bytes, strange characters, none at all."""
    enc, plain, g = tokens.Encoder(BYTE, True), library(BYTE), random.Random(6)
    alphabet = " \t\n\r  ab'1é!sS.rvelltmd''×÷ß·°ªº²ɎĀİ\x00\x1f\xa0«´<|endoftext|>Σσς中ﬁµ"
    texts = ["".join(g.choice(alphabet[: g.randrange(6, len(alphabet))]) for _ in range(g.randrange(16))) for _ in range(8000 if step > 1 else 2000)]
    texts += ["", "", "'s", "'", "x'l", "'re've", "a\n", "\n a", "  ", "a's'd 'll", "word " * 300, "中" * 300]
    for lo in range(0, len(texts), step):
        own = texts[lo : lo + step]
        got = enc.packed(pa.array(["before 's ", *own, " after"]).slice(1, len(own)), b"\7\0").to_pylist()
        assert [np.frombuffer(x, enc.kind).tolist() for x in got] == [[*plain(t), 7] for t in own]
    assert enc.packed(pa.array([], pa.string()), b"\7\0").to_pylist() == []
    assert enc.packed(pa.array(["", ""]), b"\7\0").to_pylist() == [b"\7\0"] * 2


def test_every_letter_is_cut_as_in_the_library():
    """Each code point up to U+0300 beside a letter, a number, a blank, a mark and its like, in one array."""
    enc, plain = tokens.Encoder(BYTE, True), library(BYTE)
    texts = [f"a{c}b 1{c}2 {c}  {c}{c}! {c}'s{c}" for c in map(chr, range(0x300))]
    got = [np.frombuffer(x, enc.kind).tolist() for x in enc.packed(pa.array(texts)).to_pylist()]
    assert got == [plain(t) for t in texts]


def test_token_files_look_up_each_different_piece_once_a_part(monkeypatch):
    """Not each piece of each text: 30,000 pieces of ten words are no more look-ups than there are words, first in a text or not."""
    looked, task = [], []

    class Counted(tokens.Recent):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    class Table:
        def mapInArrow(self, run, schema):
            task.append(run)

    enc, plain = tokens.Encoder(BYTE, True), library(BYTE)
    enc.known = Counted(tokens.CACHE, enc._merged)
    monkeypatch.setattr(tokenfile, "encoder", lambda path, blanks: enc)
    monkeypatch.setattr(tokenfile, "documents", lambda docs: docs)
    tokenfile.tokenise(Table(), BYTE, 0)
    texts = [" ".join(f"word{'abcdefghij'[(i + k) % 10]}" for k in range(30)) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in task[0](iter([batch])) for r in b.to_pylist() if r["counts"] is None]
    assert [np.frombuffer(r["ids"], enc.kind).tolist() for r in rows] == [[*plain(t), 0] for t in texts]
    assert len(looked) <= 20


def test_parts_hold_all_rows():
    g = random.Random(7)
    rows = [(i, "x" * g.choice((0, 5, 1 << 20, 3 << 20))) for i in range(40)] + [(40, "x" * (9 << 20)), (41, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    out = list(tokenfile.parts(iter([batch, batch.slice(0, 0), batch.slice(30)])))
    assert [i for b in out for i in b.column(0).to_pylist()] == [*range(42), *range(30, 42)]
    assert max(b.num_rows for b in out) > 1
    assert all(sum(map(len, b.column(1).to_pylist()[1:])) <= tokenfile.PART for b in out)
