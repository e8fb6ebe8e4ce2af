"""Queries that define, load, archive and drop: tables from schema files and CSV, graphs
from folders, archives, and what the stores tell of themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import profiles
from ..operators.graph import GraphStore, PropertyGraph
from ..operators.tables import Store
from ..session import shared_dir
from ..sources import archive, text_tables
from .registering import read, registry

QUERIES, query = registry()


def folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def as_lines(spark, path: str, lines: list[str]) -> str:
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def as_csv(df, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def load_csv_table(spark, sf):
    at = folder(spark)
    fields = as_lines(spark, f"{at}/schema", ["n_nationkey,BIGINT", "n_name,VARCHAR", "n_regionkey,BIGINT"])
    rows = as_csv(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{at}/rows")
    return Store(spark).load("nation", fields, rows).rows


@query("SELECT * FROM (VALUES ('left', 'id', 'bigint'), ('left', 'xs', 'array<double>'), ('made', 'k', 'int'), ('made', 'name', 'string')) t(name, field, kind)")
def create_and_drop_tables(spark, sf):
    store = Store(spark)
    store.create("left", [("id", "BIGINT"), ("xs", "DOUBLELIST")])
    store.create("gone", [("id", "BIGINT")])
    store.create_from_file("made", as_lines(spark, f"{folder(spark)}/schema", ["k,INT", "name,VARCHAR"]))
    store.drop("gone")
    store.drop("gone", if_exists=True)
    return spark.createDataFrame([(n, f, kind) for n, t in store.tables.items() for f, kind in t.info()], "name string, field string, kind string")


@query("SELECT * FROM (VALUES ('customer', true), ('orders', true), ('region', true)) t(name, sized)")
def table_statistics(spark, sf):
    store = Store(spark)
    for name in ("region", "customer", "orders"):
        store.attach(name, read(spark, sf, name))
    return spark.createDataFrame([(n, size > 0) for n, size in store.statistics()], "name string, sized boolean")


def small_graph(spark, sf) -> PropertyGraph:
    g = PropertyGraph("places").define_vertex("nation", read(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey").define_vertex("region", read(spark, sf, "region").select("r_regionkey", "r_name"), "r_regionkey")
    edges = read(spark, sf, "nation").select(F.lit(0).alias("src_type"), F.col("n_nationkey").cast("long").alias("src"), F.lit(1).alias("dst_type"), F.col("n_regionkey").cast("long").alias("dst"), F.length("n_name").alias("weight"))
    return g.insert_edges(edges)


@query("SELECT * FROM (VALUES ('nation', 'n_nationkey', 'places', true), ('nation', 'n_name', 'places', true), ('region', 'r_regionkey', 'places', true), ('region', 'r_name', 'places', true), ('edge', 'weight', 'places', true)) t(of, field, graph, incoming)")
def graph_information(spark, sf):
    info = small_graph(spark, sf).info()
    rows = [(kind, name) for kind, fields in info["vertices"].items() for name, _ in fields] + [("edge", f) for f in info["edge_fields"]]
    return spark.createDataFrame([(*r, info["name"], info["incoming"]) for r in rows], "of string, field string, graph string, incoming boolean")


@query("SELECT * FROM (VALUES ('truncated', 0::BIGINT, 0::BIGINT), ('untyped', 0::BIGINT, 0::BIGINT)) t(name, vertices, edges)")
def truncate_and_drop_graphs(spark, sf):
    store = GraphStore()
    store.put(small_graph(spark, sf), new=True)
    empty = {"truncated": store.graphs["places"].truncate(), "untyped": PropertyGraph("untyped")}
    store.drop("places")
    store.drop("places", if_exists=True)
    count = lambda name, g: g.keys().agg(F.count("*").alias("vertices")).select(F.lit(name).alias("name"), "vertices").join(g.edges().agg(F.count("*").alias("edges")).withColumn("name", F.lit(name)), "name")
    return count("truncated", empty["truncated"]).unionAll(count("untyped", empty["untyped"]))


@query("SELECT o_custkey AS src, count(*) AS edges FROM orders GROUP BY 1")
def graph_from_csv(spark, sf):
    at = folder(spark)
    customers = as_csv(read(spark, sf, "customer").select("c_custkey", "c_name"), f"{at}/customer")
    orders = as_csv(read(spark, sf, "orders").select("o_orderkey"), f"{at}/orders")
    placed = as_csv(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), f"{at}/placed")
    table = lambda path, *fields: text_tables.read_csv(spark, path, list(fields))
    g = PropertyGraph("orders").define_vertex("customer", table(customers, ("c_custkey", "BIGINT"), ("c_name", "VARCHAR")), "c_custkey").define_vertex("orders", table(orders, ("o_orderkey", "BIGINT")), "o_orderkey")
    rows = table(placed, ("src", "BIGINT"), ("dst", "BIGINT"), ("price", "DOUBLE"))
    g = g.insert_edges(rows.select(F.lit(0).alias("src_type"), "src", F.lit(1).alias("dst_type"), "dst", "price"))
    return g.edges().groupBy("src").agg(F.count("*").alias("edges"))


def graph_folder(spark, sf) -> str:
    """A folder of a line for each vertex, in the order of vec_id, and a line for each edge."""
    at = folder(spark)
    v = read(spark, sf, "embeddings").orderBy("vec_id")
    v.select(F.col("label").cast("string")).write.text(f"{at}/node-label.csv")
    v.select((2000 + F.col("vec_id") % 20).cast("string").alias("year")).write.text(f"{at}/node_year.csv")
    v.select(F.concat_ws(",", F.col("vec_id") + 0.5, F.col("label") * 2.0)).write.text(f"{at}/node-feat.csv")
    v.select("vec_id", F.col("label")).write.csv(f"{at}/edge.csv")
    return at


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vid, label, (2000 + vec_id % 20)::INT AS year, [vec_id + 0.5::DOUBLE, label * 2.0::DOUBLE] AS features FROM embeddings")
def load_graph_folder(spark, sf):
    return text_tables.read_graph_folder(spark, graph_folder(spark, sf))[0]


@query("SELECT vec_id AS src, label::BIGINT AS dst FROM embeddings")
def load_graph_folder_edges(spark, sf):
    return text_tables.read_graph_folder(spark, graph_folder(spark, sf))[1]


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vid, label, (label + 1)::INT AS pred FROM embeddings QUALIFY (row_number() OVER (ORDER BY vec_id) - 1) % 2 = 0")
def graph_predictions(spark, sf):
    v = text_tables.read_graph_folder(spark, graph_folder(spark, sf))[0]
    return text_tables.predicted_graph(v, v.filter("vid % 2 = 0").select("vid", (F.col("label") + 1).alias("pred")))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def archive_and_recover(spark, sf):
    at = folder(spark)
    archive.archive({n: read(spark, sf, n) for n in ("nation", "region")}, at, {"nation": {"layout": "ROW"}})
    back, _ = archive.recover(spark, at)
    return back["nation"].join(back["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT event_type AS task_name, ts AS started, value AS seconds FROM events WHERE user_id = 7")
def profiled_tasks(spark, sf):
    tasks = read(spark, sf, "events").select(F.col("user_id").alias("lc_id"), F.col("event_type").alias("task_name"), F.col("ts").alias("time_start"), F.col("value").alias("duration"))
    return profiles.task_profile(tasks, 7)


@query("SELECT * FROM (VALUES ('count', true), ('sum', true)) t(task_name, measured)")
def measured_tasks(spark, sf):
    profiler = profiles.TaskProfiler(spark, "data_version:1")
    with profiler.task("count"):
        read(spark, sf, "orders").count()
    with profiler.task("sum"):
        read(spark, sf, "orders").agg(F.sum("o_totalprice")).collect()
    return profiles.task_profile(profiler.tasks(), "data_version:1").select("task_name", (F.col("seconds") > 0).alias("measured"))


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def training_log_fields(spark, sf):
    return profiles.log_fields(read(spark, sf, "events"), ["event_id", "value"], F.col("event_type") == "click")
