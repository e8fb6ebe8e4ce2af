r"""Quality rules with host verdicts. Built-in functions only.

Each text is measured once, inside its row. A document fails the base rules if it has
fewer than MIN_WORDS words, or if more than half of its words stand in 3-word windows
that occur twice or more in it. Failures are aggregated by host (the column source). The
hosts' rates are taken as draws from a beta distribution that is fitted to them by
moments: their mean, and what their variance has beyond that of drawing rows. A host's
rate is shrunk to (failed + a) / (rows + a + b). The fitted prior also sets the limit: the
rate at LIFT times the odds of the prior's mean. A host is rejected with all its documents
if its rate is above the limit even SURE standard deviations of its posterior lower, so
neither a few failures nor an unremarkable difference in a large host suffice. Verdicts
are joined back to the rows of measurements, not to the texts.

Repeated windows are found by sorting one long per position: the upper bits of the
window's 64-bit hash over the position in just as many bits as the text needs, so that
equal windows are neighbours. Neighbours' words are compared; a text in which different
windows agree in those bits is sorted by its windows' words instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import barrier, table, written

MIN_WORDS = 50
#: More repeated words than this share fail.
REPEATED = 0.5
#: Times the odds of failing that a host may have, and standard deviations beyond it.
LIFT, SURE = 3.0, 1.96
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _hash(*parts):
    return F.xxhash64(*parts)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    host = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    rows = barrier(docs.select("doc_id", host.alias("source"), text.alias("text")), found=F.array_remove(F.split("text", "[ \\t-\\r]+"), ""))
    rows = barrier(rows, n=F.size("found"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    bits = F.length(F.bin(F.col("n")))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1
    rows = rows.select(
        "doc_id", "source", "n", F.char_length(F.array_join("found", "")).alias("word_chars"), (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), low.alias("low"), "found",
        F.when(F.col("n") >= 4, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: _hash(F.get("found", i), F.get("found", i + 1), F.get("found", i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))).alias("keys"),
    )
    rows = barrier(rows, sorted=F.sort_array("keys"))
    high = F.bitwise_not(F.col("low"))
    place = lambda x: x.bitwiseAND(F.col("low")).cast("int")
    same = lambda x, k, by: F.coalesce(x.bitwiseAND(high) == F.get("sorted", k + by).bitwiseAND(high), F.lit(False))
    equal = lambda i, j: (F.get("found", i) == F.get("found", j)) & (F.get("found", i + 1) == F.get("found", j + 1)) & (F.get("found", i + 2) == F.get("found", j + 2))
    false = F.filter("sorted", lambda x, k: F.when(same(x, k, 1), ~equal(place(x), place(F.get("sorted", k + 1)))).otherwise(False))
    twice = F.transform(F.filter("sorted", lambda x, k: same(x, k, 1) | ((k > 0) & same(x, k, -1))), lambda x: place(x))
    rows = barrier(rows.drop("keys"), clash=F.coalesce(F.size(false) > 0, F.lit(False)))
    spelt = F.when(F.col("clash"), F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.struct(F.get("found", i).alias("a"), F.get("found", i + 1).alias("b"), F.get("found", i + 2).alias("c"), i.alias("at")))))
    rows = barrier(rows, spelt=spelt)
    told = lambda x: F.struct(x["a"], x["b"], x["c"])
    twin = lambda x, k, by: F.coalesce(told(x) == told(F.get("spelt", k + by)), F.lit(False))
    exact = F.transform(F.filter("spelt", lambda x, k: twin(x, k, 1) | ((k > 0) & twin(x, k, -1))), lambda x: x["at"])
    rows = barrier(rows, twice=F.sort_array(F.when(F.col("clash"), exact).otherwise(twice)))
    covered = F.aggregate("twice", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    return rows.select(
        "doc_id", "source", F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_rates(rows: DataFrame) -> DataFrame:
    """(source, n, failed, rate, deviation, limit): rates shrunk towards the beta prior of
    all hosts, their posteriors' standard deviations, and the prior's limit."""
    hosts = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    own = F.col("failed") / F.col("n")
    mean = F.avg(own)
    spread = F.coalesce(F.var_samp(own), F.lit(0.0)) - F.avg(own * (1 - own) / F.col("n"))
    # moments of the beta distribution: a + b = mean (1 - mean) / variance - 1, held in 1 .. 1000
    weight = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), mean * (1 - mean) / spread - 1))).otherwise(1000.0)
    prior = hosts.agg(mean.alias("mean"), weight.alias("weight"))
    joined = hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior.withColumn("one", F.lit(1))), "one")  # one row
    rated = joined.withColumn("rate", (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight")))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1))
    limit = LIFT * F.col("mean") / (1 - F.col("mean") + LIFT * F.col("mean"))
    return rated.select("source", "n", "failed", "rate", deviation.alias("deviation"), limit.alias("limit"))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept for each row of docs, which needs doc_id and text; source names the host (one
    host for all if there is no such column, and one for nulls). Other columns are
    ignored. A null text has no words; repeated rows all count; an empty table gives an
    empty result."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * REPEATED * F.col("n_words"))
    rows = written(measured(docs).withColumn("base_failed", failed), "quality")
    bad = host_rates(rows).filter(F.col("rate") - SURE * F.col("deviation") > F.col("limit")).select(F.col("source").alias("host"))
    marked = rows.join(bad.withColumn("bad", F.lit(True)), F.col("source").eqNullSafe(F.col("host")), "left")
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"),
    )


def op5_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') GROUP BY rid),
base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source AS host, count(*) AS n, sum(base_failed::INT) AS f FROM failed GROUP BY source),
moments AS (SELECT avg(f / n) AS m, coalesce(var_samp(f / n), 0) - avg(f / n * (1 - f / n) / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM moments),
rated AS (SELECT host, n, m, k, (f + m * k) / (n + k) AS r FROM hosts, prior),
bad AS (SELECT host, true AS bad FROM rated WHERE r - 1.96 * sqrt(r * (1 - r) / (n + k + 1)) > 3.0 * m / (1 - m + 3.0 * m))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad IS NULL AS kept
FROM failed LEFT JOIN bad ON source IS NOT DISTINCT FROM host
"""
