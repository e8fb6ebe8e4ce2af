"""Exact repeated passages through suffix arrays that are sorted in two stages.

A byte goes if a string of MATCH bytes that covers it starts anywhere else too, in the
same text or in another. Texts are compared as UTF-8 bytes.

1. Equal texts are folded to one row with a count, before and in the first shuffle.
2. Each text is cut into runs of neighbouring MATCH-byte windows whose smallest GRAM-byte
   hash (the leftmost, if it occurs again) stands at the same place. Equal windows have
   equal smallest hashes at equal offsets, so they meet in that hash's bucket, and never
   in one run. Most hashes occur once in the corpus and are done with. Neighbouring equal
   runs, as periodic texts have them, are emitted as one.
3. Buckets whose runs are all equal repeat as a whole, and so do equal runs in other
   buckets: both are found by counting. The different runs of a mixed bucket are cut once
   more, by a second, independent hash. What only shares a common phrase with others
   parts from them then; what still meets gets a suffix array.
4. The suffix array: a suffix is of type B if it is smaller than its successor, else of
   type A. Only the B suffixes are sorted directly, on their first bytes. The A suffixes
   follow by scanning the buckets of first bytes in rising order: each suffix found puts
   its predecessor, if that is of type A, next in the bucket of its first byte.
   Neighbours' common prefixes of MATCH bytes or more mark the repeated windows.
5. Spans are gathered and merged for each text.

A text is told from others by its 64-bit hash and its size, a run by two 64-bit hashes.
A bucket of more than LARGE bytes (very many texts that share a passage and go on
differently) is cut on, down to single windows: its windows become rows, dealt by their
64-bit hashes, and repeat as a whole if they are counted twice, as the runs of step 3 do.
No task gathers such a bucket. Only buckets whose first hash has windows enough are
measured for that.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table

MATCH = 200
GRAM = 32
#: Bytes that are hashed, or sorted, at a time.
BLOCK = 1 << 20
SHARD = 1 << 19
#: Bits of a position in a block; the same for all blocks, lest ties be broken differently.
PLACE = 31
LARGE = 1 << 22
#: run: digest, key, size and first window, last window, last window of the first of equal
#: runs, how many those are. One array, so that all readers of a run take the same shuffle.
RUNS = "hash long, run array<long>"
_MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """A hash of the gram bytes from each position on (gram a power of two)."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1 + 1000 * seed)) * np.uint64(0xD6E8FEB86659FD93)
        factor, width = _MULTIPLIER + 2 * seed, 1
        while width < gram:
            h = h[:-width] * np.uint64(factor) + h[width:]
            factor = factor * factor % 2**64
            width *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    out, have = h, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(h) - width + 1], out[width - have : width - have + len(h) - width + 1]) if have < width else out


def runs_of(texts: list[bytes], match: int = MATCH, gram: int = GRAM, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(text number, smallest hash, first window, last window) of each run.

    The hashes' low PLACE bits give way to their positions, so that minima tell the place.
    Of hashes that agree in all other bits the leftmost is taken, in each copy alike."""
    texts_long = [(k, t) for k, t in enumerate(texts) if len(t) >= match]
    if not texts_long:
        return (np.empty(0, np.int64),) * 4
    data = np.frombuffer(b"".join(t for _, t in texts_long), np.uint8)
    hashes = gram_hashes(data, gram, seed)
    low = np.uint64((1 << PLACE) - 1)
    least = window_minima((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), match - gram + 1)
    owner, first, last, value = [], [], [], []
    at = 0
    for k, t in texts_long:
        own = least[at : at + len(t) - match + 1]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        lo = np.concatenate([[0], cuts])
        owner.append(np.full(len(lo), k))
        first.append(lo)
        last.append(np.append(cuts, len(own)) - 1)
        value.append(hashes[(own[lo] & low).astype(np.int64)])
        at += len(t)
    return np.concatenate(owner), np.concatenate(value).view(np.int64), np.concatenate(first), np.concatenate(last)


def blocks(batches):
    """Arrow batches (text as binary first), cut to about BLOCK bytes."""
    for batch in batches:
        rows, held, start = batch.column(0), 0, 0
        for k in range(batch.num_rows):
            held += len(rows[k].as_buffer() or b"")
            if held >= BLOCK or k == batch.num_rows - 1:
                yield batch.slice(start, k + 1 - start)
                held, start = 0, k + 1


def emit_runs(match: int, gram: int):
    def emit(batches):
        for block in blocks(batches):
            texts = block.column(0).to_pylist()
            keys, sizes = block.column(1).to_numpy(), block.column(2).to_numpy()
            owner, value, lo, hi = runs_of(texts, match, gram)
            digest = np.fromiter((xxhash.xxh3_64_intdigest(texts[o][a : b + match]) for o, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist())), np.uint64, len(owner)).view(np.int64)
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1]) | (value[1:] != value[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(owner)))
            run = np.column_stack([digest[at], keys[owner[at]], (sizes[owner[at]].astype(np.int64) << 32) | lo[at], hi[at + times - 1], hi[at], times])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, run.size + 1, 6, dtype=np.int32)), pa.array(run.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(value[at]), lists], ["hash", "run"])

    return emit


def sorted_suffixes(text: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at, sorted on their first depth bytes: by eight bytes as one number,
    then ties by the rest."""
    padded = np.frombuffer(text + bytes(8), np.uint8)
    head = np.ndarray((len(text),), ">u8", padded, strides=(1,))[at].astype(np.uint64)
    order = np.argsort(head, kind="stable")
    at, head = at[order], head[order]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (head[1:] == head[:-1]).view(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist()):
        at[a:b] = sorted(at[a:b].tolist(), key=lambda i: text[i : i + depth])
    return at


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """The suffixes of text in the order of their first depth bytes, at least."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    step = np.sign(t[1:].astype(np.int16) - t[:-1]).astype(np.int8)
    step = np.append(step, -1)  # the last suffix is larger than the empty one
    ahead = np.where(step != 0, np.arange(n), n)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]  # equal bytes take the type of the next unequal pair
    is_b = step[ahead] > 0
    direct = sorted_suffixes(text, np.flatnonzero(is_b), depth)
    b_first = t[direct] if len(direct) else np.empty(0, np.uint8)
    b_cuts = np.searchsorted(b_first, np.arange(257))
    queued: dict[int, list[np.ndarray]] = defaultdict(list)
    queued[int(t[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        found = []
        fresh_a = np.concatenate(queued.pop(c)) if c in queued else np.empty(0, np.int64)
        while len(fresh_a):  # predecessors with the same byte follow in the same bucket
            found.append(fresh_a)
            before = fresh_a[fresh_a > 0] - 1
            fresh_a = before[t[before] == c]
        found.append(direct[b_cuts[c] : b_cuts[c + 1]])
        bucket = np.concatenate(found)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            by = t[before]
            order = np.argsort(by, kind="stable")
            before, by = before[order], by[order]
            cuts = np.flatnonzero(by[1:] != by[:-1]) + 1
            for part in np.split(before, cuts):
                queued[int(t[part[0]])].append(part)
    return np.concatenate(out)


def shared_prefix(text: bytes, a: np.ndarray, b: np.ndarray, match: int) -> np.ndarray:
    """The common prefix of the suffixes at a and b, up to match."""
    data = np.frombuffer(text + bytes(8), np.uint8)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for k in range(0, match, 8):
        size = min(8, match - k)
        differ = words[a[alive] + k] ^ words[b[alive] + k]
        if size < 8:
            differ &= np.uint64((1 << (8 * size)) - 1)
        low = differ & (~differ + np.uint64(1))  # the lowest differing bit tells the byte
        same = np.where(differ == 0, size, np.bitwise_count(low - np.uint64(1)) // 8)
        out[alive] += same.astype(np.int64)
        alive = alive[differ == 0]
        if not len(alive):
            break
    return out


def repeated_windows(snippets: list[bytes], match: int = MATCH) -> list[np.ndarray]:
    """For each snippet, whether the window at each start also starts elsewhere."""
    text = b"\0".join(snippets) + b"\0"
    sizes = np.array([len(s) + 1 for s in snippets])
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes - 1, sizes) - np.arange(len(text))  # bytes up to the snippet's end
    order = suffix_array(text, match + 8)
    order = order[left[order] >= match]
    marked = np.zeros(len(text), bool)
    if len(order) > 1:
        same = shared_prefix(text, order[:-1], order[1:], match) >= match
        marked[order[:-1][same]] = True
        marked[order[1:][same]] = True
    return [marked[s : s + max(0, z - match)] for s, z in zip(starts.tolist(), sizes.tolist())]


REFINED = "bucket long, key long, size int, lo int, n long, snippet binary"


def refine(match: int, gram: int):
    """Rows (snippet, hash, key, size, lo, n, copies) to REFINED: each snippet's runs by a second hash."""

    def cut(batches):
        for block in blocks(batches):
            texts, *cols = (c.to_pylist() for c in block.columns)
            out = []
            for o, value, lo, hi in zip(*(c.tolist() for c in runs_of(texts, match, gram, 1))):
                first, key, size, start, n = (c[o] for c in cols[:5])
                out.append(((value ^ (first * 5 + 3)) & (2**63 - 1), key, size, start + lo, n, texts[o][lo : hi + match]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], [f.split()[0] for f in REFINED.split(", ")])

    return cut


SPANS = "key long, size int, a array<int>, b array<int>"


def mark_shards(match: int):
    """REFINED rows, a bucket's rows together, to the repeated SPANS of those found once.
    No bucket has more than LARGE bytes."""

    def mark(batches):
        ready: list[tuple] = []  # buckets with company
        bucket: list[tuple] = []
        held = 0

        def settle(rows):
            out = []
            for (_, key, size, lo, n, _), marks in zip(rows, repeated_windows([r[5] for r in rows], match)):
                if n == 1 and marks.any():
                    edge = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
                    out.append((key, size, (lo + np.flatnonzero(edge == 1)).tolist(), (lo + np.flatnonzero(edge == -1) - 1 + match).tolist()))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], [f.split()[0] for f in SPANS.split(", ")])

        def closed():
            nonlocal ready, bucket, held
            size = sum(len(r[5]) for r in bucket)
            if len(bucket) > 1 and any(r[4] == 1 for r in bucket):
                ready += bucket
                held += size
            bucket = []
            if held >= SHARD:
                yield settle(ready)
                ready, held = [], 0

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket and row[0] != bucket[0][0]:
                    yield from closed()
                bucket.append(row)
        yield from closed()
        if ready:
            yield settle(ready)

    return mark


WINDOWS = "bucket long, window long, key long, size int, start int, n long"


def windows_of(match: int):
    """REFINED rows to WINDOWS, one for each window of their snippets."""

    def spread(batches):
        for batch in batches:
            for bucket, key, size, lo, n, s in zip(*[c.to_pylist() for c in batch.columns]):
                many = len(s) - match + 1
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(s[i : i + match]) for i in range(many)), np.uint64, many).view(np.int64)
                same = [pa.array(np.full(many, v, t)) for v, t in ((bucket, np.int64), (key, np.int64), (size, np.int32), (n, np.int64))]
                start = pa.array(np.arange(lo, lo + many, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([same[0], pa.array(hashes), same[1], same[2], start, same[3]], [f.split()[0] for f in WINDOWS.split(", ")])

    return spread


def large_buckets(perhaps: DataFrame) -> DataFrame:
    """The buckets of REFINED rows with more than LARGE bytes: no more rows than the bytes
    divided by LARGE."""
    sizes = perhaps.groupBy("bucket").agg(F.sum(F.octet_length("snippet").cast("long")).alias("bytes"))
    return sizes.filter(F.col("bytes") > LARGE).select("bucket")


def marked(refined: DataFrame, perhaps: DataFrame, match: int) -> DataFrame:
    """The repeated SPANS of the REFINED rows found once. perhaps: those of the buckets that
    may be large."""
    large = F.broadcast(large_buckets(perhaps))
    small = refined.join(large, "bucket", "left_anti").select(*[f.split()[0] for f in REFINED.split(", ")])
    sorted_in_tasks = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(mark_shards(match), SPANS)
    windows = perhaps.join(large, "bucket").select(*[f.split()[0] for f in REFINED.split(", ")]).mapInArrow(windows_of(match), WINDOWS)
    twice = windows.groupBy("bucket", "window").agg(F.count("*").alias("times")).filter("times > 1").select("bucket", "window")
    counted = windows.filter("n = 1").join(twice, ["bucket", "window"])
    return sorted_in_tasks.unionAll(counted.select("key", "size", F.array("start").alias("a"), F.array((F.col("start") + match).cast("int")).alias("b")))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


KEPT = "key long, size int, n_removed long, n_spans long, kept binary"


def cut_texts(characters: bool):
    """Rows (text, key, size, copies, starts, ends) to KEPT. characters: what is left of a
    character that was cut goes too."""

    def cut(batches):
        for batch in batches:
            out = []
            for text, key, size, copies, starts, ends in zip(*[c.to_pylist() for c in batch.columns]):
                spans = [[0, size]] if copies > 1 else merged(list(zip(starts or [], ends or [])))
                edges = [0, *[x for s in spans for x in s], size]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                if characters and spans:
                    kept = kept.decode("utf-8", "ignore").encode()
                out.append((key, size, sum(b - a for a, b in spans), len(spans), kept))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], [f.split()[0] for f in KEPT.split(", ")])

    return cut


def kept_bytes(docs: DataFrame, match: int = MATCH, gram: int = GRAM, characters: bool = False) -> DataFrame:
    """KEPT for each different text of docs of at least match bytes."""
    size = F.coalesce(F.octet_length("text").cast("int"), F.lit(0))
    # All readers of texts, and all of runs, must ask for the same rows and columns to share
    # one shuffle. So what joins would infer is kept from them: the filter is not on size,
    # and a run's fields are never null.
    long = docs.filter(F.length(F.col("text").cast("binary")) >= match).select(F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("key"), size.alias("size"))
    texts = long.groupBy("key", "size").agg(F.first("text").alias("text"), F.count("*").alias("copies")).select("text", "key", "size", "copies")
    runs = texts.mapInArrow(emit_runs(match, gram), RUNS)
    part = lambda k: F.coalesce(F.col("run")[k], F.lit(0))
    digest, times = part(0), part(5)
    windows = part(4) - part(2).bitwiseAND(2**31 - 1) + 1
    counts = runs.groupBy("hash").agg(F.sum(times).alias("total"), F.min(digest).alias("one"), F.max(digest).alias("other"), F.sum(windows).alias("windows"))
    # 0: all runs are equal, 1: mixed, 2: mixed and with windows enough for more than LARGE
    # bytes after the second cut; one column, again for the readers' sake
    mix = F.when(F.col("one") == F.col("other"), 0).when(F.col("windows") * match <= LARGE, 1).otherwise(2)
    counts = counts.filter("total > 1").select("hash", mix.alias("mix"))
    alive = runs.join(counts.hint("shuffle_hash"), "hash")
    size, lo = F.shiftright(part(2), 32).cast("int"), part(2).bitwiseAND(2**31 - 1).cast("int")
    span = [part(1).alias("key"), size.alias("size"), F.array(lo).alias("a"), F.array((part(3) + match).cast("int")).alias("b")]
    mixed = alive.filter("mix > 0").withColumn("digest", digest)
    kinds = mixed.groupBy("hash", "digest").agg(F.sum(times).alias("n"), F.min("run").alias("run"), F.max("mix").alias("mix"))
    whole = mixed.join(kinds.filter("n > 1").select("hash", "digest"), ["hash", "digest"]).select(*span)
    kinds = kinds.select("hash", "n", part(1).alias("key"), size.alias("size"), lo.alias("lo"), part(4).cast("int").alias("hi"), "mix")
    pool = kinds.join(texts, ["key", "size"])
    refined = lambda rows: rows.select(F.expr(f"substring(text, lo + 1, hi - lo + {match})").alias("snippet"), "hash", "key", "size", "lo", "n", "copies").mapInArrow(refine(match, gram), REFINED)
    marks = marked(refined(pool), refined(pool.filter("mix = 2")), match)
    spans = alive.filter("mix = 0").select(*span).unionAll(whole).unionAll(marks)
    by_text = spans.groupBy("key", "size").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = texts.join(by_text, ["key", "size"], "left").select("text", "key", "size", "copies", F.flatten("spans.a").alias("starts"), F.flatten("spans.b").alias("ends"))
    return joined.mapInArrow(cut_texts(characters), KEPT)


def repeated_bytes(docs: DataFrame, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs, which needs
    doc_id and text (other columns are ignored). Texts shorter than match, empty and null
    ones lose nothing (null: no bytes). Repeated rows are copies of each other, so of match
    bytes or more they lose everything. An empty table gives an empty result."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.octet_length(text).cast("int").alias("size"), F.when(F.octet_length(text) < match, F.sha2(text.cast("binary"), 256)).alias("short"))
    kept = kept_bytes(docs, match, gram).select("key", "size", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    return rows.join(kept, ["key", "size"], "left").select(
        "doc_id", F.col("size").cast("long").alias("n_bytes"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("short", "sha").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """docs with its columns, repeated bytes cut from text. A character of which only a
    part is left goes too; n_chars, if docs has it, counts the new text. All rows stay."""
    taken = {c: fresh(docs, c) for c in ("key", "size", "own_text", "kept_key", "kept_size", "kept_text", "new_text")}
    key, size, own, kept_key, kept_size, kept_text, new = taken.values()
    rows = docs.withColumns({key: F.xxhash64("text"), size: F.octet_length("text").cast("int"), own: F.when(F.octet_length("text") < match, F.col("text"))}).drop("text")
    kept = kept_bytes(docs, match, gram, True).select(F.col("key").alias(kept_key), F.col("size").alias(kept_size), F.col("kept").cast("string").alias(kept_text))
    joined = rows.join(kept, (F.col(key) == F.col(kept_key)) & (F.col(size) == F.col(kept_size)), "left").withColumn(new, F.coalesce(own, kept_text))
    cols = [F.col(new).alias("text") if c == "text" else F.char_length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.select(*cols)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))
