"""Walks, samples and iterative measures over edges (src, dst).

Choices come from a hash of the keys, the step and the seed, so a seed gives the same
result however the data are partitioned. Iterations cut their lineage through the shared
checkpoint folder; the driver holds only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, written
from .running import running_totals
from .tables import numbered

UNIT = 2**53
FEW_WALKS = 1_000_000  # walks of up to some 60 MB are broadcast


def unit_hash(*cols):
    """A number in [0, 1) from a hash of cols."""
    return F.pmod(F.xxhash64(*cols), F.lit(UNIT)) / UNIT


def indexed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, place, dst) with places from 0 for each source, and (src, degree). A hub's
    places are counted by ranges of its edges, not in one task."""
    placed = running_totals(edges.select("src", "dst"), ["src"], ["dst"], {"place": F.lit(1).cast("long")})
    return placed.withColumn("place", F.col("place") - 1), placed.groupBy("src").agg(F.max("place").alias("degree"))


def walk_index(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """indexed, computed once for all steps and walks."""
    placed, degrees = indexed(edges)
    return written(placed, "places"), checkpointed(degrees)


def restart_walks(edges: DataFrame, seeds: DataFrame, steps: int, restart: float = 0.2, seed: int = 0, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(walk, step, vid): a walk of steps vertices from each row of seeds (vid, and walk if
    its name is not the vid). With the restart probability, and at a dead end, the next
    vertex is the first again. index: the edges' walk_index, if there is one.
    Up to FEW_WALKS walks travel to the edges; only the rows that they meet are shuffled."""
    placed, degrees = index or walk_index(edges)
    few = seeds.count() <= FEW_WALKS
    near = lambda rows, met: rows.join(F.broadcast(met), met.columns, "left_semi") if few else rows
    at = seeds.select((F.col("walk") if "walk" in seeds.columns else F.col("vid")).alias("walk"), F.col("vid").alias("home"), F.lit(0).alias("step"), F.col("vid").alias("vid"))
    out = [at]
    for k in range(1, steps):
        here = near(degrees, at.select(F.col("vid").alias("src")))
        drawn = checkpointed(at.join(here, at["vid"] == here["src"], "left").select(
            "walk", "home", "vid", (unit_hash("walk", F.lit(k), F.lit(seed)) < restart).alias("back"), F.floor(unit_hash("walk", F.lit(k), F.lit(seed + 1)) * F.col("degree")).cast("long").alias("pick")
        ))
        taken = near(placed, drawn.select(F.col("vid").alias("src"), F.col("pick").alias("place")))
        hop = drawn.join(taken, (drawn["vid"] == taken["src"]) & (drawn["pick"] == taken["place"]), "left")
        at = checkpointed(hop.select("walk", "home", F.lit(k).alias("step"), F.when(F.col("back"), F.col("home")).otherwise(F.coalesce("dst", "home")).alias("vid")))
        out.append(at)
    done = out[0]
    for part in out[1:]:
        done = done.unionByName(part)
    return done.select("walk", "step", "vid")


def walk_samples(edges: DataFrame, starts: DataFrame, steps: int, tries: int = 3, restart: float = 0.2, seed: int = 0, enough: int = 3) -> DataFrame:
    """(start, vid): the vertices sampled from each of starts (vid). Walks from the start are
    repeated, up to tries times, until they have met enough vertices; then one walk goes
    from each vertex met."""
    named = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("n"))
    first = starts.select("vid").distinct().select("vid", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("try"))
    index = walk_index(edges)
    walked = restart_walks(edges, first.select(named("vid", "try").alias("walk"), "vid"), steps, restart, seed, index)
    met = walked.groupBy(F.col("walk.start").alias("start"), "vid").agg(F.min("walk.n").alias("try"))
    counts = met.groupBy("start", "try").agg(F.count("*").alias("n"))  # at most tries rows for each start
    so_far = counts.withColumn("seen", F.sum("n").over(Window.partitionBy("start").orderBy("try")))
    last = so_far.filter(F.col("seen") >= enough).groupBy("start").agg(F.min("try").alias("last"))
    met = checkpointed(met.join(last, "start", "left").filter(F.col("try") <= F.coalesce("last", F.lit(tries))).select("start", "vid"))
    again = restart_walks(edges, met.select(named("start", "vid").alias("walk"), "vid"), steps, restart, seed + 2, index)
    return met.union(again.select("walk.start", "vid")).distinct()


def sampled_neighbours(edges: DataFrame, seeds: DataFrame, fanout: int, seed: int = 0) -> DataFrame:
    """(src, dst): up to fanout distinct edges of each seed (vid), all if fanout is negative;
    a seed without edges gets a loop to itself."""
    wanted = seeds.select(F.col("vid").alias("src")).distinct()
    own = edges.select("src", "dst").distinct().join(wanted, "src", "left_semi")
    if fanout >= 0:
        order = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "dst")
        own = own.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= fanout).drop("_n")
    alone = wanted.join(edges.select("src"), "src", "left_anti").select("src", F.col("src").alias("dst"))
    return own.unionByName(alone)


def sampled_rows(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash order of their keys."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def drawn_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, row's columns): n draws with replacement, each of a uniformly drawn place
    among the rows in key order."""
    placed = numbered(df, "_place", 0, [key])
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(unit_hash("id", F.lit(seed)) * df.count()).alias("_place"))
    return draws.join(placed, "_place").select("draw", *df.columns)


def bfs_levels(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(vid, level): the fewest steps from start (vid) along edges."""
    e = checkpointed(edges.select("src", "dst").distinct())
    seen = checkpointed(start.select("vid").distinct().withColumn("level", F.lit(0)))
    front, level = seen.select("vid"), 0
    while most is None or level < most:
        level += 1
        step = e.join(front, e["src"] == front["vid"], "left_semi").select(F.col("dst").alias("vid")).distinct()
        front = checkpointed(step.join(seen, "vid", "left_anti"))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front.withColumn("level", F.lit(level))))
    return seen


def triangles(edges: DataFrame) -> DataFrame:
    """(vid, triangles): how many triangles each vertex is in, directions and repeats
    ignored. Edges point from the end with fewer neighbours to the other, so no vertex
    has many ahead of it, however many it has; for each edge, what its first end has ahead
    beyond it meets what the other end has ahead, as lists, not as a row for each pair."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    e = e.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    first, other = F.struct(F.col("da").alias("d"), F.col("a").alias("v")), F.struct(F.col("db").alias("d"), F.col("b").alias("v"))
    e = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, other).otherwise(first).alias("far"))
    ahead = checkpointed(e.groupBy("u").agg(F.sort_array(F.collect_list("far"))["v"].alias("vs")))
    each = ahead.select("u", "vs", F.posexplode("vs").alias("at", "v")).filter(F.col("at") + 1 < F.size("vs"))
    beyond = each.select("u", "v", F.slice("vs", F.col("at") + 2, F.size("vs") - F.col("at") - 1).alias("rest"))
    found = beyond.join(ahead.toDF("v", "own"), "v").select("u", "v", F.array_intersect("rest", "own").alias("ws")).filter(F.size("ws") > 0)
    n = F.size("ws").cast("long")
    counts = F.concat(F.array(F.struct(F.col("u").alias("vid"), n.alias("n")), F.struct(F.col("v").alias("vid"), n.alias("n"))), F.transform("ws", lambda w: F.struct(w.alias("vid"), F.lit(1).cast("long").alias("n"))))
    return found.select(F.inline(counts)).groupBy("vid").agg(F.sum("n").alias("triangles"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(vid, rank) after rounds; ranks add up to 1; dead ends spread theirs evenly."""
    counted = checkpointed(edges.groupBy("src", "dst").agg(F.count("*").alias("w")))
    out = counted.groupBy("src").agg(F.sum("w").alias("out"))
    vertices = checkpointed(counted.select(F.explode(F.array("src", "dst")).alias("vid")).distinct().join(out.withColumnRenamed("src", "vid"), "vid", "left"))
    n = vertices.count()
    ranks = vertices.withColumn("rank", F.lit(1.0 / max(1, n)))
    for _ in range(rounds):
        lost = ranks.filter("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = counted.join(ranks.filter("out is not null"), counted["src"] == ranks["vid"]).select("dst", (F.col("rank") * F.col("w") / F.col("out")).alias("part"))
        got = given.groupBy(F.col("dst").alias("vid")).agg(F.sum("part").alias("part"))
        base = (1 - damping) / max(1, n) + damping * lost / max(1, n)
        ranks = checkpointed(vertices.join(got, "vid", "left").select("vid", "out", (F.lit(base) + damping * F.coalesce("part", F.lit(0.0))).alias("rank")))
    return ranks.select("vid", "rank")
