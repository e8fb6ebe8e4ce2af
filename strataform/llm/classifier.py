"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; filters over WIDTH bytes, STRIDE apart, run along the
whole text. Chunks of CHUNK bytes overlap by WIDTH - STRIDE, since the filter that starts
at a chunk's end reads into the next. Each filter is max-pooled in each chunk; the mean and
the maximum over all chunks of the text go into one logistic output. Weights are learned
by backpropagation through the pooled positions.

It is fitted on the driver on at most SAMPLE labelled rows and SAMPLE_BYTES of their
texts, chosen by a hash of doc_id, from rows for which crc32(doc_id as text) mod 5 is not
zero. Texts of more than LONGEST bytes come after all others, and one that does not fit
into what is left of SAMPLE_BYTES is passed over. Every text is scored whole, in Arrow batches
on the executors, SLAB bytes at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, table

SAMPLE = 4_000
SAMPLE_BYTES = 24_000_000
LONGEST = 240_000
DIM, STRIDE, WIDTH, FILTERS, CHUNK = 8, 4, 8, 32, 512
EPOCHS, BATCH, RATE = 10, 16, 0.004
THRESHOLD = 0.3
PADDING = 256
#: Bytes that are scored at a time: a multiple of CHUNK.
SLAB = 1 << 18
PER = CHUNK // STRIDE


def padded(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each text or part, filled up to whole chunks (one at least), and the first
    chunk of each."""
    chunks = np.array([max(1, -(-len(r) // CHUNK)) for r in raw])
    starts = np.concatenate([[0], np.cumsum(chunks)[:-1]]).astype(np.int64)
    out = np.full(int(chunks.sum()) * CHUNK, PADDING, np.int16)
    for r, s in zip(raw, starts):
        out[s * CHUNK : s * CHUNK + len(r)] = np.frombuffer(r, np.uint8)
    return out, starts


def shifted(blocks: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The block after each block of the same text; after a text's last one, padding."""
    out = np.empty_like(blocks)
    out[:-1] = blocks[1:]
    ends = np.append(starts[1:], len(blocks) // PER) * PER - 1
    out[ends] = first
    return out


def forward(model: dict, symbols: np.ndarray, starts: np.ndarray):
    """Pooled values (chunk, filter), with their positions and both halves of the input."""
    blocks = model["bytes"][symbols].reshape(-1, STRIDE * DIM)
    after = shifted(blocks, starts, np.tile(model["bytes"][PADDING], STRIDE))
    half = STRIDE * DIM
    seen = (blocks @ model["filters"][:half] + after @ model["filters"][half:]).reshape(-1, PER, FILTERS)
    at = seen.argmax(1)
    pooled = np.maximum(np.take_along_axis(seen, at[:, None], 1)[:, 0] + model["shift"], 0)
    return pooled, at, blocks, after


def features(pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(starts, len(pooled)))[:, None].astype(pooled.dtype)
    return np.hstack([np.add.reduceat(pooled, starts) / sizes, np.maximum.reduceat(pooled, starts)])


def probability(model: dict, seen: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(seen @ model["out"] + model["bias"], -30, 30)))


def pieces(text: str | None):
    """A text's bytes in parts of SLAB, each with the STRIDE bytes that follow it; one empty
    part for no text. A long text is encoded part for part."""
    held = b""
    for at in range(0, len(text or ""), SLAB):
        held += text[at : at + SLAB].encode("utf-8", "surrogatepass")
        while len(held) > SLAB + STRIDE:
            yield held[:SLAB], held[SLAB : SLAB + STRIDE]
            held = held[SLAB:]
    yield held, b""


def pooled_parts(model: dict, parts: list[bytes], nexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part the number of its chunks, and the sum and the maximum of their pooled values."""
    symbols, starts = padded(parts)
    blocks = model["bytes"][symbols].reshape(-1, STRIDE * DIM)
    follow = np.full((len(parts), STRIDE), PADDING, np.int16)
    for k, n in enumerate(nexts):
        follow[k, : len(n)] = np.frombuffer(n, np.uint8)
    after = shifted(blocks, starts, model["bytes"][follow].reshape(-1, STRIDE * DIM))
    half = STRIDE * DIM
    seen = (blocks @ model["filters"][:half] + after @ model["filters"][half:]).reshape(-1, PER, FILTERS).max(1)
    pooled = np.maximum(seen + model["shift"], 0)
    return np.diff(np.append(starts, len(pooled))), np.add.reduceat(pooled, starts, dtype=float), np.maximum.reduceat(pooled, starts)


def score(model: dict, texts: list[str | None]) -> np.ndarray:
    """Probabilities of label 1. Memory is bounded by SLAB, not by a text's length."""
    chunks, sums, tops = np.zeros(len(texts)), np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS))
    owner, parts, nexts, held = [], [], [], 0

    def settle():
        if parts:
            n, total, top = pooled_parts(model, parts, nexts)
            np.add.at(chunks, owner, n)
            np.add.at(sums, owner, total)
            np.maximum.at(tops, owner, top)
            for some in (owner, parts, nexts):
                some.clear()

    for i, text in enumerate(texts):
        for part, following in pieces(text):
            owner.append(i)
            parts.append(part)
            nexts.append(following)
            held += max(len(part), CHUNK)
            if held >= SLAB:
                settle()
                held = 0
    settle()
    return probability(model, np.hstack([sums / chunks[:, None], tops])).astype(float) if len(texts) else np.empty(0)


def gradients(model: dict, texts: list[str], labels: np.ndarray) -> dict:
    symbols, starts = padded([t.encode("utf-8", "surrogatepass") for t in texts])
    pooled, at, blocks, after = forward(model, symbols, starts)
    seen = features(pooled, starts)
    error = ((probability(model, seen) - labels) / len(labels)).astype(seen.dtype)
    sizes = np.diff(np.append(starts, len(pooled)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    top = seen[:, FILTERS:][owner] == pooled
    top = top / np.maximum(np.add.reduceat(top, starts), 1)[owner]
    pull = error[:, None] * model["out"][None, :]
    grad = (pull[:, :FILTERS] / sizes[:, None])[owner] + pull[:, FILTERS:][owner] * top
    grad = (grad * (pooled > 0)).astype(pooled.dtype)
    rows = (np.arange(len(pooled)) * PER)[:, None] + at
    half = STRIDE * DIM
    filters = np.empty_like(model["filters"])
    filters[:half] = np.einsum("cfk,cf->kf", blocks[rows], grad, optimize=True)
    filters[half:] = np.einsum("cfk,cf->kf", after[rows], grad, optimize=True)
    inner = grad[:, :, None] * model["filters"].T[None]  # chunk, filter, byte and dimension
    near = np.concatenate([symbols.reshape(-1, STRIDE), shifted(symbols.reshape(-1, STRIDE), starts, np.full(STRIDE, PADDING, np.int16))], 1)[rows]
    inner = inner.reshape(-1, DIM)
    table_grad = np.column_stack([np.bincount(near.ravel(), inner[:, d], PADDING + 1) for d in range(DIM)])
    table_grad[PADDING] = 0
    return {"bytes": table_grad, "filters": filters, "shift": grad.sum(0), "out": seen.T @ error, "bias": error.sum(keepdims=True)}


def fit(texts: list[str], labels: np.ndarray, seed: int = 0) -> dict:
    """Adam over EPOCHS; the same rows give the same model, no rows one that always says 0.5."""
    rng = np.random.default_rng(seed)
    model = {
        "bytes": rng.normal(0, 0.5, (PADDING + 1, DIM)), "filters": rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)),
        "shift": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "bias": np.zeros(1),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    model["bytes"][PADDING] = 0
    if not texts:
        model["out"][:] = 0
    mean = {k: np.zeros_like(v) for k, v in model.items()}
    square = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(order), BATCH):
            step += 1
            for name, g in gradients(model, [texts[i] for i in order[k : k + BATCH]], labels[order[k : k + BATCH]]).items():
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.99 * square[name] + 0.01 * g * g
                change = mean[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
                model[name] = (model[name] - rate * change).astype(np.float32)
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> list:
    """Rows (doc_id, quality, text) to learn from, by doc_id. Of a repeated doc_id the
    shortest text counts. The driver sees sizes first and then the texts that fit."""
    rows = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    texts = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("told")).filter("text is not null")
    # only labelled documents are grouped, so that labels of a broadcast's size keep the rest from a shuffle
    one = texts.join(rows.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("n", "told")).alias("one")).select("doc_id", "one.*")
    order = [F.col("n") > LONGEST, F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality")]
    chosen, held = [], 0
    for r in rows.join(one, "doc_id").orderBy(*order).limit(sample).select("doc_id", "quality", "n", "told").collect():
        if held + r.n <= SAMPLE_BYTES:
            held += r.n
            chosen.append(tuple(r))
    if not chosen:
        return []
    kind = docs.schema["doc_id"].dataType.simpleString()
    places = docs.sparkSession.createDataFrame(sorted({(i, n, told) for i, _, n, told in chosen}), f"doc_id {kind}, n long, told long")
    found = texts.join(F.broadcast(places), ["doc_id", "n", "told"]).groupBy("doc_id").agg(F.min("text").alias("text"))
    text_of = {r.doc_id: r.text for r in found.collect()}
    return [Row(doc_id=i, quality=q, text=text_of[i]) for i, q, _, _ in sorted(chosen)]


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model for docs, from a bounded sample of labels. Rows without a label or a
    text are not learned from; without any row the model gives 0.5 to every text."""
    found = sampled(docs, labels, sample)
    return fit([r.text for r in found], np.array([r.quality for r in found], np.float32))


def scorer(model: dict):
    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(model, texts.tolist()))

    return scored


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, which needs doc_id and
    text (other columns are ignored). Null and empty texts get the score of no bytes;
    repeated rows are all returned; a null doc_id is not held out."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(learned(docs, labels))(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their own columns."""
    mark = fresh(docs, "score")
    scored = docs.withColumn(mark, scorer(learned(docs, labels))(F.col("text")))
    return scored.filter(F.col(mark) >= THRESHOLD).drop(mark)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
