"""Queries that have to read their tables whole."""

from collections import Counter, defaultdict
from datetime import datetime

import pyarrow.parquet as pq

from strataform.operators import evaluation
from strataform.plans import catalog

SF = "/root/testdata/sf0.001"


def overlap(a, b):
    side = lambda k: max(0.0, min(a[k], b[k]) + 20 - max(a[k], b[k]))
    both = side(0) * side(1)
    return both / (800 - both)


def precision_area(hits, real, points=None):
    """hits in the order of their scores; the area by definition, recall for recall."""
    tp, curve = 0, []
    for k, hit in enumerate(hits, 1):
        tp += hit
        curve.append((tp, tp / k))
    best = lambda need: max((p for t, p in curve if t >= need), default=0.0)
    if points is None:
        return sum(best(t) for t in range(1, real + 1)) / real
    return sum(max((p for t, p in curve if t * (points - 1) >= k * real), default=0.0) for k in range(points)) / points


def by_brute_force(lines, thresholds, points=None):
    groups, real = defaultdict(list), Counter()
    for r in lines:
        x, y, n = float(r["l_partkey"] % 40), float(r["l_suppkey"] % 40), r["l_linenumber"]
        real[r["l_returnflag"]] += 1
        groups[r["l_returnflag"], r["l_orderkey"]].append(((r["l_partkey"] * 100000 + r["l_suppkey"] * 10 + n) * 100000 + (r["l_shipdate"] - datetime(1970, 1, 1)).days, x, y, (n % 4) * 2.5, (r["l_partkey"] * 7919 + r["l_suppkey"] * 104729) % 1000 / 1000))
    found = defaultdict(list)
    for (label, item), rows in groups.items():
        for det, x, y, shift, score in rows:
            iou, box = min((-overlap((x + shift, y), (a, b)), other) for other, a, b, _, _ in rows)
            found[label].append((-score, item, det, -iou, box))
    out = []
    for t in thresholds:
        for label in real:
            taken, hits = set(), []
            for _, item, _, iou, box in sorted(found[label]):
                hits.append(iou >= t and (item, box) not in taken)
                if hits[-1]:
                    taken.add((item, box))
            out.append(precision_area(hits, real[label], points))
    return sum(out) / len(out)


def test_mean_average_precision_of_the_whole_table(spark):
    lines = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate"]).to_pylist()
    got = catalog.queries()["mean_average_precision"](spark, SF).collect()[0]
    few = by_brute_force([r for r in lines if r["l_orderkey"] % 20 == 0], [0.5])
    voc, coco = by_brute_force(lines, [0.5]), 100 * by_brute_force(lines, [round(0.5 + 0.05 * k, 2) for k in range(10)], 101)
    assert abs(got.voc - voc) < 1e-8 and abs(got.coco - coco) < 1e-6 and abs(voc - few) > 1e-6


def test_mean_average_precision_by_hand(spark):
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    truth = spark.createDataFrame([("i", "c", 1, (0.0, 0.0, 10.0, 10.0)), ("j", "c", 2, (0.0, 0.0, 10.0, 10.0)), ("j", "d", 3, (0.0, 0.0, 1.0, 1.0))], f"item string, label string, box_id long, box {box}")
    found = spark.createDataFrame([("i", "c", 1, 0.9, (0.0, 0.0, 10.0, 10.0)), ("i", "c", 2, 0.8, (1.0, 0.0, 10.0, 10.0)), ("j", "c", 3, 0.7, (0.0, 0.0, 10.0, 8.7))], f"item string, label string, det long, score double, box {box}")
    got = evaluation.mean_average_precision(truth, found).collect()[0]
    # label d is never found; the third box overlaps by 0.87, enough up to 0.85
    assert abs(got.voc - (1 / 2 + 2 / 3 / 2) / 2) < 1e-12
    assert abs(got.coco - 100 * (8 * (51 + 50 * 2 / 3) / 101 + 2 * 51 / 101) / 20) < 1e-9


def test_queries_give_a_row_for_each_of_their_table(spark):
    count = lambda name: pq.read_metadata(f"{SF}/{name}.parquet").num_rows
    queries = catalog.queries()
    for name, of in (("detection_hits", "lineitem"), ("decode_annotations", "lineitem"), ("predictions_with_stamps", "events"), ("lineage_set_properties", "supplier")):
        assert queries[name](spark, SF).count() == count(of)
