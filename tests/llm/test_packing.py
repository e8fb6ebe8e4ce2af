import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strataform.llm import packing, token_output, tokens
from strataform.llm.tokens import Encoder

DOCS = "doc_id long, text string, start string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    words = ["Thing", "ÉTÉ", "don't", "x2y", "été,", "$$$", "a\tb", "İstanbul", "éte", "日本語", "'s", "<|endoftext|>", "ﬁ", "naïve-ish", "!!'ll", " nbsp", "ß", "ΣΑΣ"]
    odd = [None, "", " ", "\n\n", "\x1c a\x1db"]
    return odd + [" ".join(rng.choice(words) + rng.choice(["", "s", "."]) for _ in range(rng.choice([1, 5, 50, 900, 4000]))) for _ in range(40)]


@pytest.fixture(scope="module")
def truth():
    plain = Tokenizer.from_file(PATH)
    return {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts())}


def test_ids_equal_the_tokenizer(truth):
    own = Encoder(PATH)
    for i, t in enumerate(texts()):
        assert own.ids(t).tolist() == truth[i]


def test_pieces_cover_each_id_once(spark, truth):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts())] + [(None, "no id", "x")], DOCS)
    rows = packing.pack(docs).collect()
    by_doc, by_window = {}, {}
    for r in rows:
        if r.doc_id is not None:
            by_doc.setdefault(r.doc_id, []).append(r)
            ids = np.array(truth[r.doc_id][r.start : r.start + r.length], "<u4")
            assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(truth[r.doc_id]) == r.doc_tokens
        by_window.setdefault(r.sequence_id, []).append(r)
    for i, ids in truth.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    partial = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW
        partial += at < packing.WINDOW
    assert partial <= docs.rdd.getNumPartitions()
    assert packing.pack(docs.limit(0)).count() == 0


def test_level_is_the_least_sum_of_squares():
    rng = random.Random(1)
    bins = packing.SumOfSquares(50)
    for k in range(400):
        size = rng.randrange(1, 50)
        before = bins.counts.copy()
        at = bins.level(size)

        def cost(h):
            c = before.copy()
            c[h] -= h > 0
            if h + size < 50:
                c[h + size] += 1
            return int((c[1:] ** 2).sum())

        fits = [h for h in range(51 - size) if h == 0 or before[h]]
        assert cost(at) == min(map(cost, fits))
        bins.add(k, np.arange(size, dtype="<u2"))
    assert sum(len(i) for w in bins.taken() + bins.close() for _, _, i, _ in w)


def test_best_fit_matches_a_plain_search():
    rng = random.Random(2)
    pieces = [(k, 0, np.zeros(rng.randrange(1, 101), "<u2")) for k in range(500)]
    rooms = []
    for size in sorted((len(p[2]) for p in pieces), reverse=True):
        fit = [r for r in rooms if r >= size]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - size)
        else:
            rooms.append(100 - size)
    windows = token_output.best_fit_decreasing(pieces, 100)
    assert sorted(100 - sum(len(p[2]) for p in w) for w in windows) == sorted(rooms)


def test_matrices_round_trip(spark, truth):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts())], DOCS)
    back = {}
    for r in token_output.packed_matrices(docs).collect():
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == token_output.WINDOW and r.cu_seqlens[-1] == r.n_tokens
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            back.setdefault(d, {})[s] = ids[a:b].tolist()
        assert not ids[r.n_tokens :].any()
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in back.items()} == truth
    assert token_output.packed_matrices(docs.limit(0)).count() == 0


def test_repeated_rows_long_texts_and_written_matrices(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"word{rng.randrange(3000)}" for _ in range(160_000))  # over a million characters
    rows = [(1, long, "x"), (2, "again", "x"), (2, "again", "x"), (None, "no id", "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted((d or 0, n) for d, n in ((d, len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) + 1) for d, t, _ in rows))
    pieces = packing.pack(docs).collect()
    assert sum(r.length for r in pieces) == sum(n for _, n in want) and {(r.doc_id or 0, r.doc_tokens) for r in pieces} == set(want)
    assert sum(r.doc_id == 2 and r.start == 0 for r in pieces) == 2
    token_output.write_matrices(docs, str(tmp_path / "m"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]):
            got[d or 0] = got.get(d or 0, 0) + b - a
    assert got == {d: sum(n for e, n in want if e == d) for d, _ in want}


def test_cached_words_stay_few_and_go_at_the_end(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 20)
    known = tokens.encoder(tokens.VOCABULARY)
    list(tokens.encoded([]))
    held = lambda: sum(len(v) for k, v in vars(known).items() if isinstance(v, dict) and k != "letters")
    texts = [f"word{k} and {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} common, the" for k in range(100)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": texts})
    most = 0
    for (_, ids), text in zip(tokens.encoded([batch]), texts, strict=True):
        assert ids.tolist() == [*known.whole.encode(text, add_special_tokens=False).ids, 1]
        most = max(most, held())
    assert 40 < most < 4 * 20 + 30 and held() == 0
