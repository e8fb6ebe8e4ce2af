"""What a single task holds, or what is moved, must not grow with the tables."""

import pytest
from pyspark.sql import functions as F

from strataform.operators import evaluation, graph, traverse
from strataform.operators.graph import PropertyGraph
from strataform.operators.running import later_max, running_totals


def test_parts_and_order_checks_are_cut_to_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "FILE_EDGES", 100)
    monkeypatch.setattr(graph, "BLOCK_ROWS", 8)
    rows = spark.range(2000).selectExpr("0 AS src_type", "id % 400 AS src", "0 AS dst_type", "id AS dst")
    merged = PropertyGraph("g").insert_edges(rows, False).merge(2)
    held = [r["count"] for r in merged.main.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert sum(held) == 2000 and len(held) > 10 and max(held) < 400  # two parts of 1000 before
    assert merged.order_faults().first()[0] == 0
    bad = spark.createDataFrame([(0, k % 8 if k < 30 else 40 - k, 0, k) for k in range(35)], "src_type int, src long, dst_type int, dst long")
    bad.coalesce(1).write.parquet(str(tmp_path / "bad"))
    # after 7, 15 and 23, where blocks end, and four times from 31 on
    assert PropertyGraph("b", main=spark.read.parquet(str(tmp_path / "bad"))).order_faults().first()[0] == 7


@pytest.fixture
def many_parts(spark):
    """As with tables that fill all partitions of a shuffle."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_totals_are_carried_without_another_shuffle(spark, many_parts):
    df = spark.range(5000).selectExpr("id % 7 AS g", "id").repartition(9)
    out = running_totals(df, ["g"], ["id"], {"t": F.lit(1)}, part="p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.filter("t <> id div 7 + 1").isEmpty() and out.select("p").distinct().count() > 1
    best = later_max(out.withColumn("v", -F.col("id") % 11), ["g"], "p", F.desc("id"), "v", "m").collect()
    rows = {}
    for r in sorted(best, key=lambda r: -r.id):
        rows[r.g] = max(rows.get(r.g, -99), r.v)
        assert r.m == rows[r.g]


def test_only_recall_points_of_hits_are_kept_for_coco(spark, many_parts):
    """Precision goes up again after misses, and the order is cut into many ranges."""
    kind = "item long, label string, {0} long, {1}box struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    at = lambda ok: (0.0, 0.0, 10.0, 10.0) if ok else (90.0, 90.0, 99.0, 99.0)
    ok = [k % 5 != 0 and not 300 < k < 420 for k in range(900)]
    truth = spark.createDataFrame([(k, "c", 1, at(True)) for k in range(900)], kind.format("box_id", ""))
    found = spark.createDataFrame([(k, "c", 1, 1 - k / 1000, at(ok[k])) for k in range(900)], kind.format("det", "score double, "))
    tp, curve = 0, []
    for k, hit in enumerate(ok, 1):
        tp += hit
        curve.append((tp, tp / k))
    best = lambda need, unit: max((p for t, p in curve if t * unit >= need), default=0.0)
    voc, coco = sum(best(t, 1) for t in range(1, 901)) / 900, sum(best(k * 900, 100) for k in range(101)) / 101
    got = evaluation.mean_average_precision(truth, found).first()
    assert abs(got.voc - voc) < 1e-12 and abs(got.coco - 100 * coco) < 1e-9
    steps = evaluation.precision_steps(truth, found, [0.5])
    assert "part" in steps.columns and steps.count() == sum(ok)


def test_walks_travel_to_the_edges(spark, monkeypatch):
    """Each step's edges are scanned, not shuffled, and few or many walks go the same way."""
    e = spark.range(3000).selectExpr("id % 50 AS src", "id * 7 % 60 AS dst")
    starts = spark.range(0, 60, 3).withColumnRenamed("id", "vid")
    made = []
    index = traverse.walk_index
    monkeypatch.setattr(traverse, "walk_index", lambda edges: made.append(edges) or index(edges))
    few = sorted(map(tuple, traverse.walk_samples(e, starts, 5, 3, 0.2, 7).collect()))
    assert len(made) == 1  # twice before
    monkeypatch.setattr(traverse, "FEW_WALKS", 0)
    assert few == sorted(map(tuple, traverse.walk_samples(e, starts, 5, 3, 0.2, 7).collect())) and len({a for a, _ in few}) == 20


def test_dangling_edges_are_not_sorted_or_grouped(spark, monkeypatch):
    a = spark.range(6).withColumnRenamed("id", "k")
    new = spark.createDataFrame([(0, 1, 0, 2), (0, 1, 0, 9), (0, 9, 0, 9), (0, 9, 0, 9), (0, None, 0, 1), (0, 2, 1, 2), (0, 1, 0, 2)], "src_type int, src long, dst_type int, dst long")
    for many in (0, 10):
        monkeypatch.setattr(graph, "MANY_KEYS", many)
        g = PropertyGraph("g").define_vertex("a", a, "k")
        got = g.dangling(new)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "SortMergeJoin" not in plan and (many or "ShuffledHashJoin" in plan)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(0, 1, 0, 9), (0, 9, 0, 9), (0, 9, 0, 9), (0, None, 0, 1), (0, 2, 1, 2)]))
        assert sorted(map(tuple, g.insert_edges(new).edges().collect())) == [(0, 1, 0, 2), (0, 1, 0, 2)]


def test_triangles_make_no_row_for_each_pair(spark):
    """A vertex whose 300 neighbours have few others, a clique, and hubs with many ends."""
    pairs = {(0, k) for k in range(1, 301)} | {(a, b) for a in range(400, 412) for b in range(400, a)} | {(k, 1000 + k % 3) for k in range(1, 200)} | {(k, k + 1) for k in range(1, 50)} | {(7, 7)}
    near, want = {}, {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for v, own in near.items():
        n = sum(len(own & near[x]) for x in own) // 2
        if n:
            want[v] = n
    got = traverse.triangles(spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs if a % 2]], "src long, dst long"))
    assert {r.vid: r.triangles for r in got.collect()} == want
    assert "array_intersect" in got._jdf.queryExecution().executedPlan().toString()
