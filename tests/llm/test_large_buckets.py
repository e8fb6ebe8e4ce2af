"""Buckets of very many texts around one passage."""

import random
from collections import Counter

from strataform.llm import suffix_dedup as sd


def test_large_buckets_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(sd, "LARGE", 2000)
    rng = random.Random(5)
    passage = bytes(rng.choice(b"abc") for _ in range(40))
    text = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    rows = [(7, k, 500, 3, 1 + (k == 4), bytearray(text(20) + passage + text(20))) for k in range(60)]
    rows += [(8, k, 500, 0, 1, bytearray(text(9) + passage)) for k in (100, 101)]
    refined = spark.createDataFrame(rows, sd.REFINED)
    assert [r.bucket for r in sd.large_buckets(refined).collect()] == [7]
    gathered = []
    monkeypatch.setattr(sd, "mark_shards", lambda match, f=sd.mark_shards: gathered.append(match) or f(match))
    got = {}
    for r in sd.marked(refined, refined.filter("bucket = 7"), 24).collect():
        spans = got.setdefault(r.key, set())
        for a, b in zip(r.a, r.b):
            spans.update(range(a, b))
    seen = Counter((b, bytes(s[i : i + 24])) for b, *_, s in rows for i in range(len(s) - 23))
    want = {}
    for b, key, _, lo, n, s in rows:
        covered = {x for i in range(len(s) - 23) if seen[b, bytes(s[i : i + 24])] > 1 for x in range(lo + i, lo + i + 24)}
        if covered and n == 1:
            want[key] = covered
    assert got == want and len(got) == 61 and gathered == [24]
