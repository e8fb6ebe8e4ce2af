"""Dataset versions: which items (and annotations) each version holds.

Membership is a table (version, pos, item), not arrays, so a version may hold any number
of items. Positions keep the order in which items were added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_totals
from .tables import first_per_key


class VersionError(ValueError):
    pass


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items (item) of either, once each."""
    return a.select("item").union(b.select("item")).distinct()


def merged(members: DataFrame, versions: list, into) -> DataFrame:
    """Members of a new version: those of versions in turn, repeated items kept."""
    rank = F.lit(None).cast("int")
    for k, v in enumerate(versions):
        rank = F.when(F.col("version") == v, k).otherwise(rank)
    rows = members.withColumn("_turn", rank).filter(F.col("_turn").isNotNull()).withColumn("_group", F.lit(0))
    placed = running_totals(rows.select("_group", "_turn", "pos", "item"), ["_group"], ["_turn", "pos"], {"_at": F.lit(1).cast("long")})
    return placed.select(F.lit(into).alias("version"), (F.col("_at") - 1).alias("pos"), "item")


def appended(members: DataFrame, version, new: DataFrame) -> DataFrame:
    """members with new (pos, item) after the last of version."""
    last = members.filter(F.col("version") == version).agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
    return members.unionByName(new.select(F.lit(version).alias("version"), (F.col("pos") + int(last) + 1).cast("long").alias("pos"), "item"))


def items_of(members: DataFrame, version, rows: DataFrame, key: str) -> DataFrame:
    """The rows of a version's items, by place, repeated as often as the version has them."""
    return members.filter(F.col("version") == version).join(rows, F.col("item") == rows[key]).select("pos", *rows.columns)


def grouped_annotations(annotations: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """(key, annotations): the annotation structs of each item, by order."""
    return annotations.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("annotations"))


def categories(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, first_seen): distinct labels with the place of their first row."""
    return rows.groupBy(label).agg(F.min(order).alias("first_seen"))


def distinct_items(rows: DataFrame, key: str, order: list) -> DataFrame:
    return first_per_key(rows, [key], order)


def annotated(items: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Items that have an annotation."""
    return items.join(annotations, key, "left_semi")


def unannotated(items: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    return items.join(annotations, key, "left_anti")


def filtered(items: DataFrame, annotations: DataFrame, key: str, label: str, ids: list | None = None, labels: list | None = None, with_unannotated: bool = False) -> DataFrame:
    """Items joined with their annotations: those of ids, those with one of labels (and
    only such annotations), or both. with_unannotated keeps items without annotations."""
    if not ids and not labels:
        raise VersionError("a filter needs ids or labels")
    if ids:
        items = items.filter(F.col(key).isin(ids))
    if labels:
        annotations = annotations.filter(F.col(label).isin(labels))
    return items.join(annotations, key, "left" if with_unannotated else "inner")


def boxes(items: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Items with decoded annotations: four numbers as a box; for lines xs then ys, relative,
    as points in whole pixels (width and height are the item's)."""
    half = (F.size("values") / 2).cast("int")
    xs = F.transform(F.slice("values", 1, half), lambda v: (v * F.col("width")).cast("int"))
    ys = F.transform(F.slice("values", half + 1, half), lambda v: (v * F.col("height")).cast("int"))
    box = lambda k: F.when(F.col("kind") == "object", F.get("values", F.lit(k)))
    joined = items.join(annotations, key)
    return joined.select(key, "annot_id", "label", "kind", box(0).alias("xmin"), box(1).alias("ymin"), box(2).alias("xmax"), box(3).alias("ymax"), F.when(F.col("kind") == "line", F.arrays_zip(xs.alias("x"), ys.alias("y"))).alias("points"))


def predictions_of(items: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Predicted items with scores; stamps such as 20240131_120000_123456 are read."""
    joined = items.join(predictions, key)
    return joined.withColumn("stamp", F.try_to_timestamp(F.col("stamp"), F.lit("yyyyMMdd_HHmmss_SSSSSS")))


def filtered_predictions(images: DataFrame, predictions: DataFrame, key: str, name: str, label: str, file_names: str | None = None, labels: str | None = None, only_predicted: bool = True) -> DataFrame:
    """Images joined with their predictions, a row for each. file_names and labels are lists
    with commas, blanks around the parts ignored. Without labels, images without predictions
    are kept if only_predicted is false; with labels, only images with such predictions."""
    parts = lambda text: [p.strip() for p in text.split(",")]
    if file_names:
        images = images.filter(F.col(name).isin(parts(file_names)))
    if labels:
        predictions = predictions.filter(F.col(label).isin(parts(labels)))
    return images.join(predictions, key, "inner" if labels or only_predicted else "left")


def regrouped_by_name(images: DataFrame, predictions: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """(name, predictions): the sorted prediction structs of all images of a name, none for
    names whose images have no predictions."""
    rows = images.select(key, name).join(predictions.select(key, F.struct(*fields).alias("one")), key, "left")
    return rows.groupBy(name).agg(F.sort_array(F.collect_list("one")).alias("predictions"))
