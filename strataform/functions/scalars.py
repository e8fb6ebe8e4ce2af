"""Scalar expressions of the analytics layer: dates, dayparts, keyword classes, composite texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_days(date: Column, days: Column | int) -> Column:
    return F.date_add(date, days)


def add_time(time: Column, seconds: Column) -> tuple[Column, Column]:
    """HH:mm:ss plus seconds: the time within the day, and the days carried."""
    parts = [F.split_part(time, F.lit(":"), F.lit(k)).cast("long") for k in (1, 2, 3)]
    total = parts[0] * 3600 + parts[1] * 60 + parts[2] + seconds
    left = F.pmod(total, F.lit(86400))
    text = F.format_string("%02d:%02d:%02d", F.floor(left / 3600), F.floor(left / 60) % 60, left % 60)
    return text, F.floor(total / 86400)


def daypart(stamp: Column) -> Column:
    """daytime from 5:00 to 19:59, else nighttime."""
    return F.when(F.hour(stamp).between(5, 19), "daytime").otherwise("nighttime")


def keyword_class(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first pattern found in text, whatever its case."""
    out = F.lit(otherwise)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), label).otherwise(out)
    return out


def keyword_classes(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The labels of all patterns found in text, in the rules' order."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(label)) for p, label in rules]))


def plan_fields(plan: Column) -> dict[str, Column]:
    """Learning rate, epochs and batch size of texts such as lr0.01epochs20bsize64."""
    found = lambda pattern, kind: F.nullif(F.regexp_extract(plan, pattern, 1), F.lit("")).cast(kind)
    return {"learning_rate": found(r"lr([0-9.]+)", "double"), "epochs": found(r"epochs(\d+)", "long"), "batch_size": found(r"bsize(\d+)", "long")}


def name_parts(name: Column, fields: list[str], delimiter: str = "_") -> dict[str, Column]:
    """The delimited parts of name by field; null beyond its last."""
    parts = F.split(name, f"\\Q{delimiter}\\E")
    return {f: F.get(parts, k) for k, f in enumerate(fields)}


def range_part(value: Column, splits: list) -> Column:
    """The range partition of value: how many split points are at or below it."""
    out = F.lit(0)
    for s in splits:
        out = out + F.when(value >= s, 1).otherwise(0)
    return out.cast("long")


def hash_part(value: Column, parts: int) -> Column:
    """value modulo parts for whole numbers, never negative."""
    return F.pmod(value.cast("long"), F.lit(parts).cast("long"))
