"""Tables: typed, positional, with unique keys checked on insertion.

A Table is an immutable DataFrame with a schema, key fields and an optional running
number; each operation returns a new Table. Deletes and updates are projections, so a
snapshot is simply the Table held before. A Store names tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hash_part
from ..functions.types import schema as to_schema
from ..functions.types import spelled
from ..session import checkpointed
from ..sources.text_tables import read_csv, read_schema


class TableError(ValueError):
    pass


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by order. With struct minima instead of a window, so it
    combines in the map tasks and no key's rows are gathered."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranks = [F.expr(o) if isinstance(o, str) else o for o in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[r.alias(f"_{k}") for k, r in enumerate(ranks)], F.struct(*[F.col(c) for c in rest]).alias("row"))).alias("best"))
    return best.select(*[F.col(f"best.row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def numbered(df: DataFrame, name: str, start: int | Column, order: list[str]) -> DataFrame:
    """df with consecutive numbers from start in the given order, without bringing all
    rows to one task: rows are range-partitioned and each partition's count is carried.
    Rows and counts must come from one partitioning, so it is checkpointed."""
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = checkpointed(parts.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = counts.select("_part", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    at = F.lit(start) if isinstance(start, int) else start
    return parts.join(F.broadcast(before), "_part").select((at + F.coalesce("_before", F.lit(0)) + F.col("_place") - 1).cast("long").alias(name), *df.columns)


@dataclass(frozen=True)
class Table:
    name: str
    rows: DataFrame
    layout: str = "ROW"
    unique: tuple[str, ...] = ()
    indexed: tuple[str, ...] = ()
    running: str | None = None
    start: int = 0

    def field(self, at: int | str) -> str:
        return self.rows.columns[at] if isinstance(at, int) else at

    # -- description
    def info(self) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.rows.schema.fields]

    def missing_fields(self, names: list[str]) -> list[str]:
        return [n for n in names if n not in self.rows.columns]

    def count(self) -> int:
        return self.rows.count()

    def size_in_bytes(self) -> int:
        """The optimizer's estimate."""
        return int(str(self.rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    # -- reading
    def scan(self, fields: list[int | str] | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
        """Fields by position or name; with a limit the order makes the choice repeatable."""
        df = self.rows.orderBy(*order) if order else self.rows
        df = df.limit(limit) if limit is not None else df
        return df.select(*[self.field(f) for f in fields]) if fields is not None else df

    def scan_text(self, fields: list[int | str] | None = None) -> DataFrame:
        """All fields as text."""
        df = self.scan(fields)
        return df.select(*[spelled(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])

    def lookup(self, at: int | str, value, fields: list[int | str] | None = None) -> DataFrame:
        """Rows whose field equals value: at most one for a unique field, none if the field
        has no index."""
        name = self.field(at)
        if name not in self.unique + self.indexed:
            return self.scan(fields).limit(0)
        return replace(self, rows=self.rows.filter(F.col(name) == F.lit(value))).scan(fields)

    def where_equal(self, at: int | str, value) -> DataFrame:
        return self.rows.filter(F.col(self.field(at)) == F.lit(value))

    def lookup_many(self, key: int | str, wanted: DataFrame, on: str = "id", place: str = "pos") -> DataFrame:
        """Rows for each wanted (place, id), repeated ids repeated, with their places."""
        return wanted.join(self.rows, F.col(on) == self.rows[self.field(key)]).select(place, *[self.rows[c] for c in self.rows.columns])

    def among(self, at: int | str, wanted: DataFrame) -> DataFrame:
        """Rows whose field is among the first column of wanted, each once."""
        name = self.field(at)
        return self.rows.join(wanted.toDF(*[f"_w{k}" for k in range(len(wanted.columns))]), F.col(name) == F.col("_w0"), "left_semi")

    def bucket(self, at: int | str, parts: int, number: int) -> DataFrame:
        return self.rows.filter(hash_part(F.col(self.field(at)), parts) == number)

    # -- writing
    def insert(self, new: DataFrame, order: list[str] | None = None) -> Table:
        """Append rows, after the running number (continuing from the largest), and without
        those whose unique key is there already or came earlier in order."""
        expect = [c for c in self.rows.columns if c != self.running]
        if self.running and self.running not in new.columns:
            if len(new.columns) != len(expect):
                raise TableError(f"{len(new.columns)} fields, not {len(expect)}")
            new = new.toDF(*expect)
            top = self.rows.agg(F.coalesce(F.max(self.running) + 1, F.lit(self.start))).first()[0]
            new = numbered(new, self.running, int(top), order or expect)
        if len(new.columns) != len(self.rows.columns):
            raise TableError(f"{len(new.columns)} fields, not {len(self.rows.columns)}")
        new = new.toDF(*new.columns).select(*[F.col(c).cast(self.rows.schema[t].dataType).alias(t) for c, t in zip(new.columns, self.rows.columns)])
        for key in self.unique:
            new = first_per_key(new, [key], order or [c for c in new.columns if c != key])
            new = new.join(self.rows.select(key), key, "left_anti").select(*self.rows.columns)
        return replace(self, rows=self.rows.unionByName(new))

    def insert_at(self, new: DataFrame, slot: str = "rid") -> Table:
        """Append rows at the places that their column slot gives; rows for a place that is
        taken, or that an earlier one of new has taken, are left out."""
        rows = first_per_key(new.select(*self.rows.columns), [slot], [c for c in self.rows.columns if c != slot])
        return replace(self, rows=self.rows.unionByName(rows.join(self.rows.select(slot), slot, "left_anti").select(*self.rows.columns)))

    def update(self, condition: Column, values: dict[str, Column]) -> Table:
        return replace(self, rows=self.rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, condition: Column) -> Table:
        return replace(self, rows=self.rows.filter(~F.coalesce(condition, F.lit(False))))

    def delete_keys(self, at: int | str, keys: DataFrame) -> Table:
        name = self.field(at)
        return replace(self, rows=self.rows.join(keys.toDF("_k"), F.col(name) == F.col("_k"), "left_anti"))

    def truncate(self) -> Table:
        return replace(self, rows=self.rows.limit(0))

    def with_index(self, at: int | str, unique: bool = False) -> Table:
        name = self.field(at)
        return replace(self, unique=(*self.unique, name)) if unique else replace(self, indexed=(*self.indexed, name))

    def partitioned(self, at: int | str, parts: int) -> DataFrame:
        """Rows with their part (key modulo parts), dealt out by it."""
        name = self.field(at)
        return self.rows.withColumn("part", hash_part(F.col(name), parts)).repartition(parts, "part")


@dataclass
class Store:
    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)

    def create(self, name: str, fields: list[tuple[str, str]], layout: str = "ROW", running: str | None = None, start: int = 0) -> Table:
        if name in self.tables:
            raise TableError(f"table {name} exists")
        kinds = to_schema(fields)
        if layout not in ("ROW", "COLUMN"):
            raise TableError(layout)
        if running and not isinstance(kinds[running].dataType, (T.IntegerType, T.LongType)):
            raise TableError(f"{running} is no whole number")
        self.tables[name] = Table(name, self.spark.createDataFrame([], kinds), layout, running=running, start=start)
        return self.tables[name]

    def create_from_file(self, name: str, schema_path: str, delimiter: str = ",", layout: str = "ROW") -> Table:
        return self.create(name, read_schema(self.spark, schema_path, delimiter), layout)

    def load(self, name: str, schema_path: str, csv_path: str, delimiter: str = ",", header: bool = True, layout: str = "ROW") -> Table:
        made = self.create_from_file(name, schema_path, delimiter, layout)
        rows = read_csv(self.spark, csv_path, read_schema(self.spark, schema_path, delimiter), delimiter, header)
        return self.put(made.insert(rows))

    def attach(self, name: str, rows: DataFrame, **options) -> Table:
        """A table over rows that exist, such as a Parquet folder."""
        return self.put(Table(name, rows, **options))

    def put(self, table: Table) -> Table:
        self.tables[table.name] = table
        return table

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables and not if_exists:
            raise TableError(f"no table {name}")
        self.tables.pop(name, None)

    def statistics(self) -> list[tuple[str, int]]:
        return [(n, t.size_in_bytes()) for n, t in sorted(self.tables.items())]
