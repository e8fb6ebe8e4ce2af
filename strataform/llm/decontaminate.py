r"""Benchmark decontamination by a broadcast hash set of test n-grams. Built-in functions only.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. A window is WINDOW
consecutive words of a benchmark item; an item with fewer words, but not none, is one
window. The hashes of all windows, and of each window's first ANCHOR words (fewer if it is
shorter), are set as bits in one array, which goes to every task as a constant of the
scan: 64 bits a window, and never more than MOST_BITS (8 MB), whatever the benchmark's size.

The scan of a text hashes the words at each position. Where the anchor's bit is set, the
window is spelt out and hashed; where both of its bits are set as well, it is a candidate.
Candidates are few besides the real hits. Only they leave the row: they are joined with the
benchmark's windows on their text, which verifies them. There is one way for a benchmark of
any size; one that fills the bits has more candidates, and the same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, barrier, fresh, table, working_path, written

WINDOW = 10
ANCHOR = 4
#: Bits of the array for each window, and at most.
BITS, MOST_BITS = 64, 1 << 26
#: Bytes of windows and item ids up to which they are broadcast for the verification.
BROADCAST = 16 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NOT_WORD), "")


def _anchor(found, at, size: int):
    return F.xxhash64(F.lit(size), *[F.get(found, at + k) for k in range(size)])


def _window(found, at, size: int):
    return F.array_join(F.slice(found, at + 1, size), " ")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, size, window, anchor_size, anchor): the distinct windows of each item."""
    items = barrier(benchmark.select("item_id", words(F.col("text")).alias("found")), n=F.size("found")).filter("n > 0")
    spread = items.select("item_id", "found", F.least("n", F.lit(size)).alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)))).alias("at"))
    anchor = F.coalesce(*[F.when(F.least("size", F.lit(ANCHOR)) == k, _anchor(F.col("found"), F.col("at"), k)) for k in range(1, ANCHOR + 1)])
    return spread.select("item_id", "size", F.array_join(F.slice("found", F.col("at") + 1, F.col("size")), " ").alias("window"), F.least("size", F.lit(ANCHOR)).alias("anchor_size"), anchor.alias("anchor")).distinct()


def _hashed(window, size):
    return F.xxhash64(size, window)


def _places(h, bits: int):
    """The two bits of a window's hash."""
    return [h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)]


def ngram_bits(known: DataFrame, bits: int) -> dict[int, int]:
    """The words (64 bits each) of the bit array that are not zero: at most bits / 64 rows
    come to the driver."""
    spots = F.array(F.col("anchor").bitwiseAND(bits - 1), *_places(_hashed(F.col("window"), F.col("size")), bits))
    set_bits = known.select(F.explode(spots).alias("spot"))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").bitwiseAND(63).cast("int")))
    return {r.word: r["set"] for r in set_bits.groupBy(F.shiftright("spot", 6).alias("word")).agg(word.alias("set")).collect()}


def candidates(known: DataFrame, found, n):
    """An expression over a text's words and their number: the (at, size, window) whose
    bits are set. Empty without windows."""
    none = F.array().cast("array<struct<at:int,size:int,window:string>>")
    sizes = {r["size"]: r["count"] for r in known.groupBy("size").count().collect()}  # at most WINDOW rows
    if not sizes:
        return none
    bits = min(MOST_BITS, 1 << (BITS * sum(sizes.values())).bit_length())
    words_set = ngram_bits(known, bits)
    # one text constant, which the optimizer turns into an array once
    array = F.split(F.lit(",".join(str(words_set.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>")

    def is_set(spot):
        return F.call_function("shiftright", F.get(array, F.shiftright(spot, 6).cast("int")), spot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    def at_size(size: int):
        short = min(size, ANCHOR)
        positions = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        # a lambda over one element keeps its hash from being computed for each use
        near = F.filter(positions, lambda i: F.exists(F.array(_anchor(found, i, short).bitwiseAND(bits - 1)), is_set))
        spelt = F.transform(near, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), _window(found, i, size).alias("window")))
        return F.filter(spelt, lambda w: F.exists(F.array(_hashed(w["window"], w["size"])), lambda h: is_set(_places(h, bits)[0]) & is_set(_places(h, bits)[1])))

    return F.concat(none, *[at_size(size) for size in sorted(sizes)])


def _covered(hits):
    """How many positions the windows (at, size) cover together."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1)))))


def verified(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """(row, hits, ids) for the rows of scanned (row, near) with a real hit. near: the
    candidates. known is broadcast if its size, which is checked, allows it."""
    named = known.groupBy("window").agg(F.collect_set("item_id").alias("ids"))
    size = named.agg(F.sum(F.octet_length("window") + 16 + 24 * F.size("ids")).alias("size")).first()["size"]
    named = F.broadcast(named) if (size or 0) <= BROADCAST else named
    spread = scanned.filter(F.size("near") > 0).select("row", F.inline("near"))
    return spread.join(named, "window").groupBy("row").agg(F.collect_set(F.struct("at", "size")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. A
    null or empty text has no words; repeated rows are all returned; items without an id
    hit words but are not listed; without benchmark rows nothing is hit."""
    known = windows(benchmark, size)
    found = barrier(docs.select("doc_id", words(F.col("text")).alias("found")), n=F.size("found"))
    rows = found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("n").alias("n_words"), candidates(known, F.col("found"), F.col("n")).alias("near"))
    rows = written(rows, "scanned")  # read twice, and row numbers must stay the same
    each = rows.drop("near").join(verified(rows, known), "row", "left")
    texts = F.sort_array(F.transform(F.coalesce("ids", F.array()), lambda i: i.cast("string")))
    n_hit = F.coalesce(_covered(F.col("hits")), F.lit(0))
    return each.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size(texts).cast("long").alias("n_items"),
        F.sha2(F.array_join(texts, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the rows that any benchmark window occurs in, with their own columns.

    The scan writes the rows without candidates apart from those with some, so that only
    the latter, which are few, are verified and joined."""
    known = windows(benchmark, size)
    mark, count, row, near, doubt = (fresh(docs, c) for c in ("found", "n", "row", "near", "doubt"))
    rows = barrier(docs.withColumn(mark, words(F.col("text"))), **{count: F.size(mark)})
    rows = rows.withColumns({row: F.monotonically_increasing_id(), near: candidates(known, F.col(mark), F.col(count))}).drop(mark, count)
    rows = rows.withColumn(doubt, (F.size(near) > 0).cast("int"))
    path = working_path(docs.sparkSession, "doubts")
    rows.write.partitionBy(doubt).parquet(path)
    rows = docs.sparkSession.read.schema(rows.schema).parquet(path)
    doubtful = rows.filter(F.col(doubt) == 1)
    hit = verified(doubtful.select(F.col(row).alias("row"), F.col(near).alias("near")), known).select(F.col("row").alias(row))
    return rows.filter(F.col(doubt) == 0).select(*docs.columns).unionAll(doubtful.join(hit, row, "left_anti").select(*docs.columns))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
known AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
spots AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
spelt AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM spots, (SELECT DISTINCT size FROM known) WHERE i + size - 1 <= len(w)),
hits AS (SELECT rid, i, s.size, item_id FROM spelt s JOIN known k ON k.win = s.win),
covered AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
