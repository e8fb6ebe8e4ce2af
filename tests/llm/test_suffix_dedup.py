import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strataform.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, key string, n_chars long"


def brute(texts, match):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + match] for d in data for i in range(len(d) - match + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - match + 1):
            if seen[d[i : i + match]] > 1:
                gone[i : i + match] = [True] * match
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("letters", [b"a", b"ab", b"\0\x01", b"abcdefgh\0\xff"])
def test_suffix_array(letters):
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 200, 1500):
        text = bytes(rng.choice(letters) for _ in range(n))
        assert sd.suffix_array(text, n + 1).tolist() == sorted(range(n), key=lambda i: text[i:])


def test_repeated_windows():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    for match in (5, 8, 13):
        seen = Counter(p[i : i + match] for p in parts for i in range(len(p) - match + 1))
        for p, marks in zip(parts, sd.repeated_windows(parts, match)):
            assert marks.tolist() == [seen[p[i : i + match]] > 1 for i in range(len(p) - match + 1)]


def test_runs_cover_each_window_once():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (10, 200, 201, 1000)] + [b"z" * 900]
    owner, _, lo, hi = sd.runs_of(texts)
    for k, t in enumerate(texts):
        spans = [(a, b) for o, a, b in zip(owner, lo, hi) if o == k]
        assert [x for a, b in spans for x in range(a, b + 1)] == list(range(max(0, len(t) - 199)))


@pytest.mark.parametrize("match,gram,large", [(200, 32, 1 << 22), (24, 4, 1 << 22), (200, 32, 300)])
def test_against_brute_force(spark, match, gram, large, monkeypatch):
    monkeypatch.setattr(sd, "SHARD", 3000)
    monkeypatch.setattr(sd, "LARGE", large)
    monkeypatch.setattr(sd, "BLOCK", 5000)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(260), text(205), text(120)]
    texts = [None, "", "short", text(199), text(5000), "x" * 700, "ab" * 400, "é" * 150]
    for k in range(24):
        cut = rng.randrange(60)
        texts.append(text(rng.randrange(300)) + shared[k % 3][cut:] + text(rng.randrange(200)) + (shared[(k + 1) % 3] if k % 4 == 0 else ""))
    texts += [texts[-1], texts[-1], texts[-2] + "!", text(90) + texts[10], shared[0] + shared[0], "\ufffd" + "é" * 150 + "ö\ufffd"]
    docs = spark.createDataFrame([(k, t, "clash", len(t or "")) for k, t in enumerate(texts)] + [(None, texts[4], "c", 1)], DOCS)
    want = brute([*texts, texts[4]], match)
    got = sorted(((r.doc_id if r.doc_id is not None else len(texts), r) for r in sd.repeated_bytes(docs, match, gram).collect()), key=lambda x: x[0])
    assert [tuple(r)[1:] for _, r in got] == [w[:4] for w in want]
    cut = {r.doc_id: r for r in sd.without_repeats(docs, match, gram).collect()}
    for k, t in enumerate(texts):
        clean = want[k][4].decode("utf-8", "ignore")
        assert cut[k].key == "clash" and (cut[k].text == clean or t is None) and (t is None or cut[k].n_chars == len(clean))
    assert sd.repeated_bytes(docs.limit(0)).count() == 0


def test_clashing_names_and_equal_hash_bits(spark, monkeypatch):
    monkeypatch.setattr(sd, "PLACE", 55)  # nine bits of hash: ties everywhere
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared = text(300)
    texts = [text(rng.randrange(50, 3000)) + shared[rng.randrange(40) :] + text(rng.randrange(400)) for _ in range(12)]
    clash = ["key", "size", "own_text", "kept_key", "kept_size", "valid", "made", "new_text", "copies", "run"]
    docs = spark.createDataFrame([(k, t, *clash) for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    got = {r.doc_id: r for r in sd.without_repeats(docs).collect()}
    for k, w in enumerate(brute(texts, 200)):
        assert got[k].text == w[4].decode() and [got[k][c] for c in clash] == clash
