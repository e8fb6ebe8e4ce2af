"""Accuracy of predictions: classes, graph nodes and detected boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_broadcast
from .running import later_max, running_totals
from .tables import first_per_key


def accuracy(rows: DataFrame, truth: str, predicted: str, by: str | None = None) -> DataFrame:
    """Percent of equal labels, of all rows or by a field."""
    share = (F.avg((F.col(truth) == F.col(predicted)).cast("double")) * 100).alias("accuracy")
    return rows.groupBy(by).agg(F.count("*").alias("n"), share) if by else rows.agg(F.count("*").alias("n"), share)


def first_label_accuracy(truth: DataFrame, predicted: DataFrame, name: str, order: str) -> DataFrame:
    """Percent of items (name) whose first label agrees on both sides."""
    a = first_per_key(truth.select(name, order, "label"), [name], [order]).select(name, F.col("label").alias("t"))
    b = first_per_key(predicted.select(name, order, "label"), [name], [order]).select(name, F.col("label").alias("p"))
    return accuracy(a.join(b, name), "t", "p")


def mean_fps(rows: DataFrame, fps: str = "fps") -> DataFrame:
    """The mean of fps; 0 without any."""
    return rows.agg(F.coalesce(F.avg(fps), F.lit(0.0)).alias("fps"))


def mean_fps_without_first(rows: DataFrame, order: str, fps: str = "fps") -> DataFrame:
    """mean_fps of all but the first row by order, in which a model warms up."""
    first = rows.agg(F.min(order)).first()[0]
    return mean_fps(rows.filter(F.col(order) > F.lit(first)), fps)


def overlap(a: str, b: str):
    """Intersection over union of two box structs (xmin, ymin, xmax, ymax)."""
    width = F.greatest(F.lit(0.0), F.least(f"{a}.xmax", f"{b}.xmax") - F.greatest(f"{a}.xmin", f"{b}.xmin"))
    height = F.greatest(F.lit(0.0), F.least(f"{a}.ymax", f"{b}.ymax") - F.greatest(f"{a}.ymin", f"{b}.ymin"))
    area = lambda x: (F.col(f"{x}.xmax") - F.col(f"{x}.xmin")) * (F.col(f"{x}.ymax") - F.col(f"{x}.ymin"))
    both = width * height
    return F.try_divide(both, area(a) + area(b) - both)  # null if neither box has an area


def matched(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(label, item, det, score, iou, ahead): each detection's overlap with its best box of
    its label in the item, and the best overlap that a better scored detection has with
    that box. iou is null without a box. So a detection is a hit for thresholds above
    ahead, up to iou: one pass serves all thresholds."""
    pairs = found.join(truth.select("item", "label", "box_id", F.col("box").alias("real")), ["item", "label"], "left")
    iou = F.when(F.col("box_id").isNotNull(), F.coalesce(overlap("box", "real"), F.lit(0.0)))
    # the join has brought a detection's boxes together: numbering them takes no shuffle
    order = Window.partitionBy("item", "label", "det").orderBy(F.desc("iou"), "box_id")
    best = pairs.withColumn("iou", iou).select("item", "label", "det", "score", "box_id", "iou", F.row_number().over(order).alias("turn")).filter("turn = 1")
    before = Window.partitionBy("item", "label", "box_id").orderBy(F.desc("score"), "det").rowsBetween(Window.unboundedPreceding, -1)
    return best.select("label", "item", "det", "score", "iou", F.max("iou").over(before).alias("ahead"))


def is_hit(threshold: float):
    """Whether a row of matched is a hit for threshold."""
    return F.coalesce(F.col("iou") >= threshold, F.lit(False)) & F.coalesce(F.col("ahead") < threshold, F.lit(True))


def detections(truth: DataFrame, found: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, label, item, det, score, hit): each detection's best box of its label in
    the item is a hit if it overlaps enough and no better scored detection has that box.

    truth: (item, label, box_id, box), found: (item, label, det, score, box)."""
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), is_hit(t).alias("hit")) for t in thresholds])
    rows = matched(truth, found).select("label", "item", "det", "score", F.inline(each))
    return rows.select("threshold", "label", "item", "det", "score", "hit")


def precision_steps(truth: DataFrame, found: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, label, part, tp, real, precision): for each hit the number of hits so far,
    of all real boxes, the precision, and the range of the order that it is in. The
    detections are ordered once for all thresholds; only hits are spread over them."""
    hits = {f"_tp{k}": is_hit(t).cast("long") for k, t in enumerate(thresholds)}
    # ranges are found by a pass of their own: without this shuffle it would match all anew
    ranked = matched(truth, found).repartition("item", "det").withColumn("worse", -F.col("score")).drop("score")
    curve = running_totals(ranked, ["label"], ["worse", "item", "det"], {"seen": F.lit(1).cast("long"), **hits}, ["label", "iou", "ahead"], "part")
    curve = curve.join(small_broadcast(truth.groupBy("label").agg(F.count("*").alias("real"))), "label")
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), is_hit(t).alias("hit"), F.col(f"_tp{k}").alias("tp")) for k, t in enumerate(thresholds)])
    steps = curve.select("label", "part", "real", "seen", F.inline(each)).filter("hit")
    return steps.select("threshold", "label", "part", "tp", "real", (F.col("tp") / F.col("seen")).alias("precision"))


def areas(steps: DataFrame, truth: DataFrame, thresholds: list[float], points: int | None = None) -> DataFrame:
    """(threshold, label, ap) from precision_steps, by the best precision at each recall or
    any higher one; 0 for labels without a hit."""
    keys = ["threshold", "label"]
    if points is None:
        best = later_max(steps, keys, "part", F.desc("tp"), "precision", "best")
        area = best.groupBy(*keys).agg(F.sum(F.col("best") / F.col("real")).alias("ap"))
    else:  # of the hits that reach the same points only the best counts
        top = steps.groupBy(*keys, F.floor(F.col("tp") * (points - 1) / F.col("real")).alias("point")).agg(F.max("precision").alias("precision"))
        order = Window.partitionBy(*keys)
        best = F.max("precision").over(order.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        width = F.col("point") - F.coalesce(F.lag("point").over(order.orderBy("point")), F.lit(-1))
        area = top.select(*keys, (best * width).alias("area")).groupBy(*keys).agg((F.sum("area") / points).alias("ap"))
    labels = truth.select("label").distinct().withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return labels.join(area, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def average_precision(truth: DataFrame, found: DataFrame, thresholds: list[float], points: int | None = None) -> DataFrame:
    """(threshold, label, ap): the area under the interpolated precision, at all recalls or
    at evenly spaced points (101 for the COCO rule)."""
    return areas(precision_steps(truth, found, thresholds), truth, thresholds, points)


def mean_average_precision(truth: DataFrame, found: DataFrame) -> DataFrame:
    """voc: mean over labels at overlap 0.5; coco: mean over labels and overlaps 0.5 to
    0.95 at 101 recalls, times 100."""
    thresholds = [round(0.5 + 0.05 * k, 2) for k in range(10)]
    steps = precision_steps(truth, found, thresholds)
    voc = areas(steps.filter(F.col("threshold") == 0.5), truth, [0.5]).agg(F.avg("ap").alias("voc"))
    coco = areas(steps, truth, thresholds, 101).agg((F.avg("ap") * 100).alias("coco"))
    return voc.withColumn("_", F.lit(1)).join(coco.withColumn("_", F.lit(1)), "_").drop("_")
