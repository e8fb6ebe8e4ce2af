"""SimHash near-duplicates, linked through vantage-point partitions.

A fingerprint is 64 bits of word-shingle votes. Two fingerprints link when they
differ in at most RADIUS bits; documents whose fingerprints are connected by links
form a component.

How the links are found. In a vantage-point (VP) tree a set is split by the distance
to a chosen point, and by the triangle bound a ball of radius r only has to visit the
sides that [d - r, d + r] touches. Whole 64-bit fingerprints concentrate at distance
32 +- 4, so a radius of 3 straddles most median cuts and a tree over them alone would
copy each row to nearly all shards. The partitions are therefore cut in two metrics:

* block metric: the 64 bits are dealt to BLOCKS blocks, RADIUS of which can hold a
  difference. So linked fingerprints agree entirely on at least one choice of the
  other blocks: distance zero under that choice's mask. With radius zero the triangle
  bound says that they have the same distance to each vantage point, under that mask.
  The path of those distances is the first part of a shard's key.
* whole metric: the distance to one more vantage point cuts each cell into bands of
  BAND values. A fingerprint lives in its home band and visits each band that its
  radius overlaps.

In a shard a VP tree over the residents, on whole fingerprints, answers residents and
visitors exactly. A leaf reduces its hits to stars, so no shard emits all its pairs:
the links returned connect exactly what the full set of links connects. Shards with
more than SHARD_ROWS rows (tight groups that no distance separates) are dealt into a
square grid of tiles: residents to one of its rows, askers to one of its columns.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, shared_dir, table, written

RADIUS = 3
SHINGLE = 3
SEED = 42
BAND = 8
#: Rows of a shard from which on it is dealt to tiles.
SHARD_ROWS = 16_384
#: Fingerprints that a shard should hold on average; sets the length of the distance path.
AIM = 1_024
LEAF = 128
#: Characters of a text whose words are hashed at a time.
SLAB = 1 << 19
_SPACE = re.compile("[\t-\r ]")
#: Vantage points: multiples of the odd 64-bit golden-ratio constant.
VANTAGE = [(0x9E3779B97F4A7C15 * (j + 1)) % 2**64 for j in range(12)]


def word_slabs(text: str):
    """The words of a text, lower-cased, as lists from about SLAB characters each."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + SLAB)
        end = cut.end() if cut else len(text)
        yield text[at:end].encode("utf-8", "surrogatepass").lower().split()
        at = end


def shingle_hashes(text: str | None, size: int = SHINGLE):
    """XXH64 of the shingles, repeats included, in arrays; none for texts without words."""
    carried: list[bytes] = []
    whole = True
    for words in word_slabs(text or ""):
        words = carried + words
        if len(words) >= size:
            whole = False
            yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)))), itertools.repeat(SEED)), np.uint64)
        carried = words[1 - size :] if size > 1 else []
    if whole and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def simhash(texts: pd.Series) -> np.ndarray:
    """Signed 64-bit fingerprints; zero where there are no words (nulls included)."""
    votes, counts = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    todo: list[tuple[int, np.ndarray]] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if not todo:
            return
        starts = np.cumsum([0, *(len(h) for _, h in todo[:-1])])
        bits = np.unpackbits(np.concatenate([h for _, h in todo]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        owner = [i for i, _ in todo]
        np.add.at(votes, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        np.add.at(counts, owner, [len(h) for _, h in todo])
        todo.clear()
        held = 0

    for i, text in enumerate(texts):
        for h in shingle_hashes(text):
            todo.append((i, h))
            held += len(h)
            if held > 100_000:
                settle()
    settle()
    return np.packbits(2 * votes > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(simhash(texts))


def signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def block_masks(rows: int) -> list[int]:
    """Masks of the bits on which linked fingerprints may agree: one for each choice of
    len(blocks) - RADIUS blocks. More rows take more, longer masks, so that few
    unrelated fingerprints agree on one; any choice finds every link."""
    blocks = 4 if rows < 2**25 else 5 if rows < 2**32 else 6
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(parts, blocks - RADIUS)]


def shards(prints: DataFrame, rows: int) -> DataFrame:
    """(cell, band, home, fp): each fingerprint once at home in each mask, and as a
    visitor in the bands that its radius overlaps."""
    depth = max(0, min(9, round(math.log(max(1, rows / AIM), 6))))  # a path of nine fits in 63 bits
    fp = F.col("fp")
    far = F.bit_count(fp.bitwiseXOR(F.lit(signed(VANTAGE[0])))).cast("int")
    paths = []
    for k, mask in enumerate(block_masks(rows)):
        path = F.lit(k).cast("long")
        for v in VANTAGE[1 : depth + 1]:
            path = path * 65 + F.bit_count(fp.bitwiseXOR(F.lit(signed(v))).bitwiseAND(F.lit(signed(mask))))
        paths.append(path)
    band = F.sequence(F.floor((F.greatest(far - RADIUS, F.lit(0))) / BAND), F.floor((far + RADIUS) / BAND))
    return (
        prints.select("fp", F.floor(far / BAND).alias("own"), F.explode(F.array(*paths)).alias("cell"), band.alias("bands"))
        .select("fp", "cell", "own", F.explode("bands").alias("band"))
        .select("cell", "band", (F.col("own") == F.col("band")).alias("home"), "fp")
    )


def tiled(rows: DataFrame) -> DataFrame:
    """(cell, band, tile, home, asks, fp). Shards above SHARD_ROWS become a grid: residents
    are dealt to its rows, and everyone, residents too, asks from one of its columns, so
    that each pair meets in one tile and no tile holds more than a share of either."""
    sizes = rows.groupBy("cell", "band").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_ROWS)
    joined = rows.join(sizes, ["cell", "band"], "left")
    side = F.ceil(F.coalesce("n", F.lit(1)) / SHARD_ROWS).cast("long")
    row, column = F.pmod(F.xxhash64("fp"), F.col("side")), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("side"))
    along = F.sequence(F.lit(0).cast("long"), F.col("side") - 1)
    spot = lambda tile, home, asks: F.struct(tile.alias("tile"), home.alias("home"), asks.alias("asks"))
    one = F.array(spot(F.lit(0).cast("long"), F.col("home"), F.lit(True)))
    asking = F.transform(along, lambda r: spot(r * F.col("side") + column, F.lit(False), F.lit(True)))
    living = F.when(F.col("home"), F.transform(along, lambda c: spot(row * F.col("side") + c, F.lit(True), F.lit(False)))).otherwise(F.array().cast("array<struct<tile:bigint,home:boolean,asks:boolean>>"))
    placed = joined.select("cell", "band", "home", "fp", side.alias("side")).withColumn("spots", F.when(F.col("side") == 1, one).otherwise(F.concat(asking, living)))
    return placed.select("cell", "band", "fp", F.inline("spots"))


def _stars(queries: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between queries and leaf that connect what all close pairs connect."""
    near = np.bitwise_count(queries[:, None] ^ leaf[None, :]) <= RADIUS
    near &= queries[:, None] != leaf[None, :]
    hit = near.any(1)
    if not hit.any():
        return queries[:0], queries[:0]
    queries, near = queries[hit], near[hit]
    width = len(leaf)
    label = np.arange(width)
    while True:  # the smallest leaf position that each is connected to
        own = np.where(near, label, width).min(1)
        new = np.minimum(label, np.where(near, own[:, None], width).min(0))
        if (new == label).all():
            break
        label = new
    tied = label != np.arange(width)
    return np.concatenate([queries, leaf[tied]]), np.concatenate([leaf[own], leaf[label[tied]]])


def vp_links(home: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(n, 2) links between distinct fingerprints of home and of queries (which may
    repeat home's), through a VP tree over home."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(home, queries)]
    while todo:
        points, asked = todo.pop()
        if not len(points) or not len(asked):
            continue
        far = np.bitwise_count(points ^ points[len(points) // 2]).astype(np.int16)
        cut = np.median(far)
        inside = far <= cut
        if len(points) <= LEAF or inside.all():
            for i in range(0, len(points), 4 * LEAF):
                for j in range(0, len(asked), 4096):
                    found.append(_stars(asked[j : j + 4096], points[i : i + 4 * LEAF]))
            continue
        asks = np.bitwise_count(asked ^ points[len(points) // 2]).astype(np.int16)
        todo.append((points[inside], asked[asks - RADIUS <= cut]))
        todo.append((points[~inside], asked[asks + RADIUS > cut]))
    if not found:
        return np.empty((0, 2), home.dtype)
    return np.column_stack([np.concatenate(x) for x in zip(*found)])


def spanning(pairs: np.ndarray) -> np.ndarray:
    """A star for each component of the links: (member, smallest member)."""
    if not len(pairs):
        return pairs
    names, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(names))
    return np.column_stack([names[rest], names[label[rest]]])


def _shard_links(rows: pd.DataFrame) -> pd.DataFrame:
    fp = rows["fp"].to_numpy(np.int64).view(np.uint64)  # bit counts of signed numbers are of their absolute values
    at_home, asks = rows["home"].to_numpy(bool), rows["asks"].to_numpy(bool)
    pairs = spanning(vp_links(np.unique(fp[at_home]), np.unique(fp[asks])))
    pairs = pairs.view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def components(links: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint that has a link: root is the smallest in its
    connected component. Alternating large and small stars; each round is checkpointed."""
    shared_dir(links.sparkSession)

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = edges.join(low, "u")
        if large:
            out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.filter(F.col("u") > F.col("v")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct().checkpoint()
    before = None
    while (now := state(edges)) != before:
        before, edges = now, star(star(edges, True), False).checkpoint()
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def link_components(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp), a written table, with component_id: the smallest doc_id that
    its links reach, its own included (nulls are passed over; null if there is no other)."""
    unique = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rows = unique.count()
    links = tiled(shards(unique.select("fp"), rows)).groupBy("cell", "band", "tile").applyInPandas(_shard_links, "a long, b long")
    roots = components(links)
    named = unique.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs.

    Null, empty and blank texts have no words and the fingerprint zero, which links like
    any other. Repeated rows are all returned. Other columns of docs are ignored. An
    empty table gives an empty result."""
    prints = written(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    return link_components(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but the first document of each component: the row with the
    smallest doc_id stays (one of them, if rows repeat it; nulls come last)."""
    mark = fresh(docs, "kept")
    # one key of one column, nullable on both sides, so that the join and the removal of
    # repeated rows take one shuffle of texts
    key = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text")).cast(f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},text:bigint>")
    prints = written(docs.select("doc_id", fingerprint(F.col("text")).alias("fp"), key.alias(mark)), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col(mark).alias("key")))
    kept = link_components(prints).groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias(mark))
    return docs.withColumn(mark, key).join(kept, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
