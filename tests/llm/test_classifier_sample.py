"""The bounded sample that the classifier learns from."""

import zlib

import numpy as np

from strataform.llm import classifier

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def learnable(n):
    return [i for i in range(5 * n) if zlib.crc32(str(i).encode()) % 5][:n]


def test_long_texts_do_not_displace_the_others(spark, monkeypatch):
    monkeypatch.setattr(classifier, "SAMPLE_BYTES", 3000)
    monkeypatch.setattr(classifier, "LONGEST", 500)
    ids = learnable(42)
    rows = [(i, ("é" if i == ids[0] else "x") * 3001 if i in ids[:2] else f"text {i} " * 5) for i in ids]
    rows += [(ids[5], "another and longer text of the same number " * 4)] * 3
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2) for i in ids], LABELS)
    got = classifier.sampled(docs, labels, 4000)
    assert [r.doc_id for r in got] == ids[2:] and all(r.text == f"text {r.doc_id} " * 5 and r.quality == r.doc_id % 2 for r in got)


def test_bytes_are_bounded_in_hash_order(spark, monkeypatch):
    monkeypatch.setattr(classifier, "SAMPLE_BYTES", 1000)
    ids = learnable(60)
    docs, labels = spark.createDataFrame([(i, "é" * 50) for i in ids], DOCS), spark.createDataFrame([(i, 1) for i in ids], LABELS)
    got = [r.doc_id for r in classifier.sampled(docs, labels, 4000)]
    assert len(got) == 10 and got != ids[:10]


def test_only_long_texts_still_teach(spark, monkeypatch):
    monkeypatch.setattr(classifier, "LONGEST", 5)
    ids = learnable(8)
    docs, labels = spark.createDataFrame([(i, "longer than five") for i in ids], DOCS), spark.createDataFrame([(i, 1) for i in ids], LABELS)
    assert [r.doc_id for r in classifier.sampled(docs, labels, 4000)] == ids


def test_without_rows_each_text_gets_a_half(spark):
    docs, labels = spark.createDataFrame([(1, "text"), (2, ""), (3, None)], DOCS), spark.createDataFrame([], LABELS)
    assert [r.score for r in classifier.quality_scores(docs, labels).collect()] == [0.5] * 3
    assert classifier.keep_good(docs, labels).count() == 3
    assert np.all(classifier.score(classifier.fit([], np.empty(0, np.float32)), ["a", "b" * 900]) == 0.5)
