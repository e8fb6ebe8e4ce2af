import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from strataform.llm import token_output, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = "!#$%&()*+-./:;=?@[]^_{}~"


@pytest.fixture(scope="module")
def own():
    return tokens.Encoder(PATH)


def words(rng, n, most):
    common = ["the", "and", "ing", "tion", "aaaa", "é", "ß", "ÿö", "ent", "1", "zq"]
    return ["".join(rng.choice(common if rng.random() < 0.6 else "abcdefghijklmnopqrstuvwxyzàéíöü") for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_words_are_merged_without_a_call_for_each(own, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(words(rng, 60, 5)) for _ in range(20)] + ["a", "Don't 'sure it's!!'ll x2y3 " + SIGNS, "aaaaaaa bbbbbbbbbb"]
    want = [[*own.whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    monkeypatch.setattr(own, "model", None)  # neither is asked
    monkeypatch.setattr(own, "whole", None)
    assert [own.ids(t).tolist() for t in texts] == want


@pytest.mark.parametrize("most", [2, 8, 30])
def test_merges_are_the_models(own, most):
    rng = random.Random(most)
    some = [*words(rng, 3000, most), *(s * k for s in ("a", "é", "ab", "!", "-'") for k in (1, 2, 3, 7, 20, 21, 40, 41, 90))]
    got = own.merges.ids(some, own._word).to_pylist()
    assert got == [own._word(w) for w in some]
    assert len(own.merges.ids(some[:1], own._word)) == 1


def test_slabs_and_steps_give_the_same_ids(own, monkeypatch):
    rng = random.Random(12)
    texts = [rng.choice([None, "", " ", "\n", "日本語 ab", "<|endoftext|> x", "\t", "Á é"]) if rng.random() < 0.3 else " ".join(words(rng, rng.randint(1, 100), 4)) for _ in range(40)]
    want = [[*own.whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})
    for kind in (pa.string(), pa.large_string()):
        odd = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(kind)], ["doc_id", "text"])
        for slab, cached in ((1 << 22, 25_000), (500, 7), (1, 1)):
            monkeypatch.setattr(tokens, "SLAB", slab)
            monkeypatch.setattr(tokens, "CACHED", cached)
            got = list(tokens.encoded([odd.slice(0, 0), odd.slice(0, 25), odd.slice(25)], PATH))
            assert [d for d, _ in got] == list(range(40))
            assert [i.tolist() for _, i in got] == want
            assert all(i.dtype == np.dtype("<u2") for _, i in got)


def test_sequences_of_matrices_ask_the_model_for_no_word(spark):
    """As op9 packs them: in workers whose encoder has no model left to ask."""
    rng = random.Random(13)
    texts = [" ".join(words(rng, 50, 4)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {k: [*tokens.encoder(PATH).whole.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}

    def blind(batches):
        known = tokens.encoder(PATH)
        model, known.model = known.model, None
        try:
            for doc_id, ids in tokens.encoded(batches, PATH):
                yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "ids": [ids.tolist()]})
        finally:
            known.model = model

    assert {r.doc_id: r.ids for r in docs.mapInArrow(blind, "doc_id long, ids array<long>").collect()} == want
    got = {d: np.frombuffer(r.input_ids, "<u2")[a:b].tolist() for r in token_output.packed_matrices(docs).collect() for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:])}
    assert got == want
