import random
import subprocess
import sys

import pandas as pd
import xxhash
from pyspark.sql import functions as F

from strataform.llm import simhash

DOCS = "doc_id long, text string, lang string, fp string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, f"{prints[i]:016x}", min(groups[find(i)])) for i, (d, _) in enumerate(rows))


def test_small_cases_and_near_copies(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice(["alpha", "Beta", "gamma", "dé", "of", "the"]) + str(rng.randrange(40)) for _ in range(300)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "two words"), (4, " \t\n "), (5, "ONE")]
    for t in base:
        rows.append((len(rows), t))
        for _ in range(6):
            words = t.split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + 500, base[0])] * 2
    docs = spark.createDataFrame([(d, t, "x", "clash") for d, t in rows], DOCS)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == brute_components(rows)
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in got}) and kept[0].fp == "clash"


def test_tiles_and_deep_paths_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)
    monkeypatch.setattr(simhash, "AIM", 20)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(300)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(3)})
    prints += [centres[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.link_components(df).collect()}
    want = list(range(len(prints)))
    changed = True
    near = [[j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(prints))]
    while changed:
        changed = False
        for i, js in enumerate(near):
            low = min(want[j] for j in js)
            for j in js:
                if want[j] != low:
                    want[j], changed = low, True
    assert [got[i] for i in range(len(prints))] == want


def test_long_texts_are_hashed_in_slabs(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["Ab", "c", "é", " ", "\t", "\n ", "\u00a0"]) for _ in range(n)) for n in (0, 1, 2, 30, 500, 4000)] + ["x" * 300, " " * 300, "a b " * 200, None]
    want = [brute_print(t) for t in texts]
    for slab in (1, 2, 7, 64, 1 << 19):
        monkeypatch.setattr(simhash, "SLAB", slab)
        assert [int(v) % 2**64 for v in simhash.simhash(pd.Series(texts, dtype=object))] == want


def test_a_very_long_text_takes_little_memory():
    code = "import pandas as pd; from strataform.llm import simhash as s; t = 'some text, one ' * 3_000_000; s.simhash(pd.Series([t])); print([int(x.split()[1]) // 1024 for x in open('/proc/self/status') if x.startswith('VmHWM')][0])"  # the peak of this program alone
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500


def test_no_tile_holds_a_large_shard(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 50)
    rows = spark.range(1000).selectExpr("1L AS cell", "2L AS band", "id % 4 > 0 AS home", "id AS fp").unionByName(spark.range(30).selectExpr("1L AS cell", "3L AS band", "true AS home", "id AS fp"))
    tiles = simhash.tiled(rows).groupBy("band", "tile").agg(F.count_if("home").alias("homes"), F.count_if("asks").alias("asks")).collect()
    assert len(tiles) == 401 and all(r.homes <= 75 and r.asks <= 90 for r in tiles if r.band == 2)
    assert [(r.homes, r.asks) for r in tiles if r.band == 3] == [(30, 30)]


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_rows_without_id(spark):
    words = [" ".join(f"w{i * k % 97}" for i in range(80)) for k in (3, 5)]
    docs = spark.createDataFrame([(None, words[0], "x", "x"), (None, words[0], "x", "x"), (None, words[1], "x", "x"), (4, words[1], "x", "x")], DOCS)
    assert sorted((r.doc_id or 0, r.text == words[0]) for r in simhash.keep_one(docs).collect()) == [(0, True), (4, False)]
    assert sorted((r.component_id or 0) for r in simhash.near_duplicates(docs).collect()) == [0, 0, 4, 4]
