"""Property graphs: typed vertices, multi-edges with properties, delta and main parts.

A vertex is known by its type number and key. Edges are rows (src_type, src, dst_type, dst,
properties); new ones go to the delta, which merge() folds into the main part, dealt out
and sorted by source. Both parts together are the graph, whatever has been merged. Edges
that only one direction's lists have are marked in the column WAY.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .tables import first_per_key

ENDS = ["src_type", "src", "dst_type", "dst"]
EDGES, VERTICES, KEYS = "src_type int, src long, dst_type int, dst long", "vpid int, key long", "vpid int, key long"
WAY = "_way"  # "out" or "in" for edges of one direction's lists only, else null
FILE_EDGES = 2_000_000  # about as many edges at most are sorted and written by one task of merge()
MANY_KEYS = 1_000_000  # vertices from which joins with edges hash them
BLOCK_ROWS, BLOCKS = 2**17, 8  # order_faults looks at blocks of a file's rows, about so many in a task


class GraphError(ValueError):
    pass


@dataclass(frozen=True)
class VertexType:
    name: str
    key: str
    rows: DataFrame


@dataclass(frozen=True)
class PropertyGraph:
    name: str
    types: tuple[VertexType, ...] = ()
    main: DataFrame | None = None
    delta: DataFrame | None = None
    incoming: bool = True
    edge_fields: tuple[str, ...] = field(default=())

    # -- definition
    def define_vertex(self, name: str, rows: DataFrame, key: str) -> PropertyGraph:
        if any(t.name == name for t in self.types):
            raise GraphError(f"vertex type {name} exists")
        return replace(self, types=(*self.types, VertexType(name, key, rows)))

    def type_number(self, name: str) -> int:
        return [t.name for t in self.types].index(name)

    def info(self) -> dict:
        return {"name": self.name, "vertices": {t.name: t.rows.dtypes for t in self.types}, "edge_fields": list(self.edge_fields), "incoming": self.incoming}

    # -- vertices
    def insert_vertices(self, name: str, new: DataFrame, order: list[str | Column]) -> PropertyGraph:
        """Insert those whose key is not there; stored properties stay; of new rows with
        one key the first by order is taken."""
        at = self.type_number(name)
        t = self.types[at]
        rows = first_per_key(new, [t.key], order).join(t.rows.select(t.key), t.key, "left_anti")
        types = list(self.types)
        types[at] = replace(t, rows=t.rows.unionByName(rows.select(*t.rows.columns)))
        return replace(self, types=tuple(types))

    def keys(self) -> DataFrame:
        """(vpid, key) of all vertices."""
        out = _empty(KEYS) if not self.types else None
        for k, t in enumerate(self.types):
            rows = t.rows.select(F.lit(k).alias("vpid"), F.col(t.key).cast("long").alias("key"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def vertices(self) -> DataFrame:
        """All types' rows with vpid and key; a type's missing fields are null."""
        out = _empty(VERTICES) if not self.types else None
        for k, t in enumerate(self.types):
            rows = t.rows.select(F.lit(k).alias("vpid"), F.col(t.key).cast("long").alias("key"), *[c for c in t.rows.columns if c != t.key])
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def vertex(self, name: str, key, fields: list[str] | None = None) -> DataFrame:
        t = self.types[self.type_number(name)]
        rows = t.rows.filter(F.col(t.key) == F.lit(key))
        return rows.select(*fields) if fields else rows

    def known(self, wanted: DataFrame) -> DataFrame:
        """The (vpid, key) rows of wanted that are vertices."""
        return wanted.join(self.keys(), ["vpid", "key"], "left_semi")

    def vertex_counts(self) -> DataFrame:
        return self.keys().groupBy("vpid").agg(F.count("*").alias("vertices"))

    # -- edges
    def stored(self) -> DataFrame:
        """All edge rows of both parts, with the properties that any insertion had."""
        parts = [p for p in (self.main, self.delta) if p is not None] or [_empty(EDGES)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def edges(self, incoming: bool = False) -> DataFrame:
        """The edges of the outgoing (or incoming) lists; no rows for a graph without edges."""
        rows = self.stored()
        if WAY not in rows.columns:
            return rows
        return rows.filter(F.col(WAY).isNull() | (F.col(WAY) == ("in" if incoming else "out"))).drop(WAY)

    def truncate(self) -> PropertyGraph:
        """The definitions without vertices and edges."""
        return replace(self, types=tuple(replace(t, rows=t.rows.limit(0)) for t in self.types), main=None, delta=None, edge_fields=())

    def dangling(self, new: DataFrame) -> DataFrame:
        """The rows of new with an end that is no vertex."""
        known = self._lookup()
        no_source = _ended(new, known, "src", "left_anti")
        no_target = _ended(_ended(new, known, "src", "left_semi"), known, "dst", "left_anti")
        return no_source.unionByName(no_target).select(*new.columns)

    def _lookup(self) -> DataFrame:
        """keys for joins with edges: many are hashed, so that tasks hold vertices only and
        do not sort the edges."""
        known = self.keys()
        return known.hint("shuffle_hash") if known.count() > MANY_KEYS else known

    def insert_edges(self, new: DataFrame, checked: bool = True, ignore_in: bool = False, only_in: bool = False) -> PropertyGraph:
        """Append to the delta; repeated edges are kept. checked: only edges between
        vertices are taken. A later insertion may have other properties; what a row lacks
        is null. ignore_in: not in the incoming lists; only_in: only there, where src names
        the vertex whose list it is (nothing is written if the graph keeps no such lists)."""
        if missing := [c for c in ENDS if c not in new.columns]:
            raise GraphError(f"edges lack {missing}")
        if only_in and (not self.incoming or ignore_in):
            return self
        if checked:
            known = self._lookup()
            new = _ended(_ended(new, known, "src", "left_semi"), known, "dst", "left_semi")
        fields = [c for c in new.columns if c not in ENDS]
        ends = ["dst_type", "dst", "src_type", "src"] if only_in else ENDS
        new = new.select(*[F.col(a).alias(b) for a, b in zip(ends, ENDS)], *fields)
        if only_in or ignore_in and self.incoming:
            new = new.withColumn(WAY, F.lit("in" if only_in else "out"))
        delta = new if self.delta is None else self.delta.unionByName(new, allowMissingColumns=True)
        return replace(self, delta=delta, edge_fields=tuple(dict.fromkeys((*self.edge_fields, *fields))))

    def edge_counts(self) -> DataFrame:
        return self.edges().groupBy("src_type", "dst_type").agg(F.count("*").alias("edges"))

    def merge(self, parts: int | None = None, least: int = 0, per_part: int | None = None) -> PropertyGraph:
        """Fold the delta into the main part: dealt out by source range, sorted in each part,
        and written, so later scans by source skip most row groups. Edges of source types
        with fewer than least new edges stay in the delta; per_part sets the parts' number
        by the edges that each shall hold. A part of more than FILE_EDGES is cut on by source
        into as many files as that needs, in order, so no task's sort grows with the graph."""
        if self.delta is None:
            return self
        ready, rest = self, None
        if least:
            many = self.delta.groupBy("src_type").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("src_type").collect()  # at most a row for each vertex type
            kinds = [r.src_type for r in many]
            if not kinds:
                return self
            inside = F.col("src_type").isin(kinds)
            ready, rest = replace(self, delta=self.delta.filter(inside)), self.delta.filter(~inside)
        rows = ready.stored()
        total = rows.count()
        if per_part:
            parts = max(1, -(-total // per_part))
        files = parts and parts * max(1, -(-total // (parts * FILE_EDGES)))
        if not parts and total > FILE_EDGES:
            files = max(-(-total // FILE_EDGES), rows.sparkSession.sparkContext.defaultParallelism)
        ranged = rows.repartitionByRange(*([files] if files else []), "src_type", "src").sortWithinPartitions("src_type", "src", "dst_type", "dst")
        return replace(self, main=written(ranged, f"{self.name}-main"), delta=rest)

    def order_faults(self) -> DataFrame:
        """(faults): neighbours of the main part's files that are out of order, and files
        whose source ranges overlap the next file's. Tasks get blocks of a file's rows, not
        whole files; what a block begins and ends with is compared in a table of blocks."""
        if self.main is None:
            return _empty("faults long").agg(F.count("*").alias("faults"))
        files = self.main.select("_metadata.file_path").distinct().withColumn("file", F.row_number().over(Window.orderBy("file_path")))  # one row for each file
        rows = self.main.select("_metadata.file_path", F.col("_metadata.row_index").alias("row"), *ENDS).join(F.broadcast(files), "file_path")
        tasks = max(1, -(-self.main.count() // (BLOCK_ROWS * BLOCKS)))
        rows = rows.select("file", F.expr(f"row div {BLOCK_ROWS}").alias("block"), "row", *ENDS).repartition(tasks, "file", "block")
        rows = rows.select("file", "block", "row", F.struct(*ENDS).alias("at"))
        rows = rows.withColumn("before", F.lag("at").over(Window.partitionBy("file", "block").orderBy("row")))
        wrong = lambda condition: F.coalesce(condition.cast("long"), F.lit(0))
        blocks = rows.groupBy("file", "block").agg(F.sum(wrong(F.col("before") > F.col("at"))).alias("n"), F.min_by("at", "row").alias("first"), F.max_by("at", "row").alias("last"), F.min("at").alias("low"), F.max("at").alias("high"))
        blocks = blocks.withColumn("before", F.lag("last").over(Window.partitionBy("file").orderBy("block")))
        whole = blocks.groupBy("file").agg(F.sum(F.col("n") + wrong(F.col("before") > F.col("first"))).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        across = whole.withColumn("before", F.lag("high").over(Window.orderBy("low")))
        overlaps = F.struct("before.src_type", "before.src") >= F.struct("low.src_type", "low.src")
        return across.agg(F.coalesce(F.sum(F.col("n") + wrong(F.col("before").isNotNull() & overlaps)), F.lit(0)).alias("faults"))

    # -- neighbours
    def directed(self, incoming: bool) -> DataFrame:
        """Edges as (type, key, other_type, other, properties), by source or by destination."""
        if incoming and not self.incoming:
            raise GraphError(f"{self.name} has no incoming edges")
        e = self.edges(incoming)
        names = ["dst_type", "dst", "src_type", "src"] if incoming else ENDS
        return e.select(*[F.col(a).alias(b) for a, b in zip(names, ["type", "key", "other_type", "other"])], *self.edge_fields)

    def adjacency(self, incoming: bool = False) -> DataFrame:
        """(type, key, neighbours): sorted, repeated neighbours kept."""
        return self.directed(incoming).groupBy("type", "key").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))

    def neighbours(self, name: str, key, other: str, fields: list[str] | None = None, incoming: bool = False) -> DataFrame:
        """Property rows of a vertex's neighbours of one type, with the first edge property."""
        t = self.types[self.type_number(other)]
        own = self.directed(incoming).filter((F.col("type") == self.type_number(name)) & (F.col("key") == F.lit(key)) & (F.col("other_type") == self.type_number(other)))
        first = list(self.edge_fields[:1])
        joined = own.join(t.rows, own["other"] == t.rows[t.key])
        return joined.select(*[t.rows[c] for c in (fields or t.rows.columns)], *[own[c] for c in first])


def _ended(rows: DataFrame, known: DataFrame, end: str, how: str) -> DataFrame:
    """rows whose end is (left_semi) or is not (left_anti) among known (vpid, key)."""
    on = (rows[f"{end}_type"] == known["vpid"]) & (rows[end] == known["key"])
    return rows.join(known, on, how)


def _empty(schema: str) -> DataFrame:
    return SparkSession.active().createDataFrame([], schema)


@dataclass
class GraphStore:
    """Graphs by name."""

    graphs: dict[str, PropertyGraph] = field(default_factory=dict)

    def put(self, graph: PropertyGraph, new: bool = False) -> PropertyGraph:
        if new and graph.name in self.graphs:
            raise GraphError(f"graph {graph.name} exists")
        self.graphs[graph.name] = graph
        return graph

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.graphs and not if_exists:
            raise GraphError(f"no graph {name}")
        self.graphs.pop(name, None)


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(src, dst) with an end among seeds (vid), in either direction, each edge row once."""
    s = seeds.select(F.col("vid").alias("_s")).distinct().withColumn("_hit", F.lit(True))
    out = edges.join(s, F.col("src") == F.col("_s"), "left").withColumn("_a", F.col("_hit")).drop("_s", "_hit")
    out = out.join(s, F.col("dst") == F.col("_s"), "left")
    return out.filter(F.col("_a").isNotNull() | F.col("_hit").isNotNull()).select(*edges.columns)
