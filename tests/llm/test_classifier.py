import random
import zlib

import numpy as np
import pytest

from strataform.llm import classifier

DOCS = "doc_id long, text string, score string"


def data():
    rng = random.Random(4)
    out = []
    for i in range(500):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(20, 200))]
        good = i % 3 > 0
        out.append((i, " ".join(words if good else [w + "$$$" for w in words]), int(good)))
    return out


def test_held_out_accuracy_and_cases(spark):
    rows = data()
    extra = [(901, None, "x"), (902, "", "x"), (None, rows[1][1], "x"), (1, rows[1][1], "x"), (903, "a " * 60000, "x")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + extra, DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held if r.doc_id < 900} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_text = {r.doc_id: r.score for r in got}
    assert abs(by_text[901] - by_text[902]) < 1e-6
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and 300 < kept.count() < 360
    assert classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 20, n)) for n in (3, 700, 1500)]
    model = {k: v.astype(np.float64) for k, v in classifier.fit(texts, np.array([0, 1, 0], np.float32)).items()}
    labels = np.array([1.0, 0, 1])

    def loss():
        symbols, starts = classifier.padded([t.encode() for t in texts])
        p = classifier.probability(model, classifier.features(classifier.forward(model, symbols, starts)[0], starts).astype(np.float64))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = classifier.gradients(model, texts, labels)
    for name, place in (("filters", (5, 3)), ("filters", (60, 9)), ("out", (40,)), ("bytes", (100, 2)), ("shift", (3,))):
        kept, eps = model[name][place], 1e-3
        model[name][place] = kept + eps
        up = loss()
        model[name][place] = kept - eps
        down = loss()
        model[name][place] = kept
        assert abs((up - down) / (2 * eps) - grads[name][place]) < 0.02 * max(0.1, abs(grads[name][place]))


def plain_score(model, text):
    """The network by its definition: each filter at each place, chunk by chunk."""
    data = list((text or "").encode())
    chunks = max(1, -(-len(data) // classifier.CHUNK))
    data += [classifier.PADDING] * (chunks * classifier.CHUNK + classifier.STRIDE - len(data))
    pooled = []
    for c in range(chunks):
        best = np.full(classifier.FILTERS, -np.inf)
        for at in range(c * classifier.CHUNK, (c + 1) * classifier.CHUNK, classifier.STRIDE):
            window = np.concatenate([model["bytes"][b] for b in data[at : at + classifier.WIDTH]])
            best = np.maximum(best, window @ model["filters"])
        pooled.append(np.maximum(best + model["shift"], 0))
    seen = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)])
    return float(1 / (1 + np.exp(-(seen @ model["out"] + model["bias"])))[0])


@pytest.mark.parametrize("slab", [512, 1024, 1 << 18])
def test_score_against_plain_loops(monkeypatch, slab):
    monkeypatch.setattr(classifier, "SLAB", slab)
    rows = data()[:60]
    model = classifier.fit([t for _, t, _ in rows], np.array([q for *_, q in rows], np.float32))
    rng = random.Random(7)
    sizes = [0, 1, 3, 4, 5, 508, 511, 512, 513, 515, 516, 517, 1023, 1024, 1028, 1029, 2060, 5000]
    texts = [None] + ["".join(rng.choice("ab $é€") for _ in range(n)) for n in sizes] + ["x" * n for n in sizes]
    got = classifier.score(model, texts)
    assert np.abs(got - [plain_score(model, t) for t in texts]).max() < 1e-5
    assert np.abs(got - np.concatenate([classifier.score(model, [t]) for t in texts])).max() < 1e-6


def test_a_very_long_text_takes_little_memory():
    import subprocess
    import sys

    code = "import numpy as np; from strataform.llm import classifier as c; m = c.fit([], np.empty(0, np.float32)); m['out'][:] = 1; t = 'some text, é ' * 4_000_000; c.score(m, ['a', t]); print([int(x.split()[1]) // 1024 for x in open('/proc/self/status') if x.startswith('VmHWM')][0])"  # the peak of this program alone
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500
