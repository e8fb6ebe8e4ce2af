import random
import zlib

from test_native import brute_hits
from test_simhash import brute_components
from test_suffix_dedup import brute

import corpus_pipeline
from strataform.llm import classifier
from strataform.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgjlmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(30)) for k in range(4)]
    shared = text(60)
    docs = [text(rng.randrange(80, 250)) for _ in range(160)]
    for k in range(0, 40, 5):
        docs.append(docs[k])
        docs.append(docs[k] + " more " + word())
    docs += [text(50) + " " + shared + " " + text(50) for _ in range(6)]
    docs += [text(40) + " " + t + " " + text(40) for _, t in items]
    docs += [" ".join(w + "$$$" for w in text(120).split()) for _ in range(80)]
    docs += ["", None]
    labels = [(k, int("$$$" not in (t or ""))) for k, t in enumerate(docs) if k % 3]
    return docs, labels, items


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(docs)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    sets = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = classifier.learned(sets, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {k: t for k, t in enumerate(docs) if classifier.score(model, [t])[0] >= classifier.THRESHOLD}
    assert sum("$$$" in (t or "") for t in left.values()) < 4 and len(left) > 180
    left = {d: left[d] for d in sorted({c for _, _, c in brute_components(list(left.items()))})}
    cut = dict(zip(left, brute(list(left.values()), 200)))
    left = {k: None if t is None else cut[k][4].decode("utf-8", "ignore") for k, t in left.items()}
    left = {k: t for k, t in left.items() if not brute_hits(t, items)[-1]}

    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids_crc32, r.length, r.doc_tokens))
    assert set(got) == set(left)
    for k, t in left.items():
        ids = encoder().ids(t).astype("<u4")
        for start, crc, length, tokens in got[k]:
            assert tokens == len(ids) and zlib.crc32(ids[start : start + length].tobytes()) == crc
        assert sum(p[2] for p in got[k]) == len(ids)


def test_stage_columns(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(labels[:60], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, t, "en", "s", 1, "clash", "clash", "clash") for k, t in enumerate(docs[:30])]
    rows += [rows[3], rows[3], (None, None, None, None, None, None, None, None), (None, docs[5], "en", None, 1, None, None, None)]
    some = spark.createDataFrame(rows, DOCS + ", key string, found string, valid string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, some, str(tmp_path))
        assert out.columns == some.columns and 0 < out.count() <= len(rows)
        assert {r.key for r in out.collect()} <= {"clash", None}
        assert stage(spark, some.limit(0), str(tmp_path)).count() == 0
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, some, str(tmp_path)).collect()} == {r[0] for r in rows}
