import public_tokenizers as public
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from helixframe.llm import pii, quality
from helixframe.llm.common import load, materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "near_copies", "personal_data", "packing"]
    docs = load(spark, SF, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    frames = []
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        frames.append(docs)
    names = frames[0].columns
    kept = [{r["doc_id"]: r for r in f.collect()} for f in frames[:4]]
    assert all(f.columns == names for f in frames[:4])
    assert set(kept[0]) <= set(before) and set(kept[1]) < set(kept[0]) and set(kept[2]) <= set(kept[1]) and set(kept[3]) == set(kept[2])
    # quality: by the base rules at least
    for i, r in kept[0].items():
        b = quality.base_rules(r["text"])
        if quality.fails(b[0], b[4]):
            assert i not in kept[1]
    assert len(kept[1]) > 0.7 * len(before)
    # near copies: none is left, and what went has a copy that stays
    sets = {i: set(zip(*(r["text"].encode().lower().split()[k:] for k in range(5)))) for i, r in kept[1].items()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ids = sorted(kept[2])
    assert not any(near(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for i in set(kept[1]) - set(kept[2]):
        assert any(near(i, j) for j in kept[1] if j != i)
    # personal data is gone, clean texts are as they were
    for i, r in kept[3].items():
        old = kept[2][i]["text"]
        assert not pii.base_spans(r["text"])
        if not pii.base_spans(old):
            assert r["text"] == old
        assert r["source"] == kept[2][i]["source"]
    # packing: all ids of all texts that are left
    plain = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want = sum(len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept[3].values())
    assert sum(r["length"] for r in frames[4].collect()) == want
    run = pipeline.run(spark, SF)
    cols = ["doc_id", "start", "length", "doc_tokens"]
    assert sorted(r["doc_id"] for r in run.select(*cols).distinct().collect() if r["start"] == 0) == sorted(kept[3])


def test_stages_on_an_empty_table(spark):
    docs = load(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
