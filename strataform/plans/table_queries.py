"""Queries over tables: scans, lookups, insertion, constraints, types, partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, types
from ..operators import partitioning
from ..operators.tables import Store, Table, numbered
from ..sources.text_tables import columns_to_rows
from .registering import read, registry

QUERIES, query = registry()


def table(spark, sf, name, **options) -> Table:
    return Store(spark).attach(name, read(spark, sf, name), **options)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY 1 LIMIT 10")
def scan_project_limit(spark, sf):
    return table(spark, sf, "nation").scan([0, 1], 10, ["n_nationkey"])


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def scan_fields(spark, sf):
    return table(spark, sf, "customer").scan([0, 2, "c_mktsegment"])


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey, CASE WHEN s_acctbal > 0 THEN 'True' ELSE 'False' END AS in_credit FROM supplier")
def scan_as_text(spark, sf):
    t = table(spark, sf, "supplier")
    marked = Table("s", t.rows.withColumn("in_credit", F.col("s_acctbal") > 0))
    return marked.scan_text(["s_suppkey", "s_name", "s_nationkey", "in_credit"])


@query("SELECT * FROM customer WHERE c_custkey = 42")
def index_search_unique(spark, sf):
    return table(spark, sf, "customer", unique=("c_custkey",)).lookup(0, 42)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42")
def index_search_multi(spark, sf):
    return table(spark, sf, "orders", indexed=("o_custkey",)).lookup("o_custkey", 42, ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey FROM orders WHERE false")
def index_search_without_index(spark, sf):
    return table(spark, sf, "orders").lookup("o_custkey", 42, ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def equality_filter(spark, sf):
    t = table(spark, sf, "customer")
    least = t.rows.agg(F.min("c_mktsegment")).first()[0]
    return t.where_equal("c_mktsegment", least).select("c_custkey", "c_name")


@query("SELECT pos, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 11), (4, 900000000)) w(pos, id) JOIN customer ON c_custkey = id")
def ordered_lookup_by_ids(spark, sf):
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 11), (4, 900000000)], "pos int, id long")
    return table(spark, sf, "customer").lookup_many(0, wanted)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 3)")
def inlist_semijoin(spark, sf):
    wanted = read(spark, sf, "orders").filter("o_custkey % 50 = 3").select("o_orderkey")
    return table(spark, sf, "lineitem").among("l_orderkey", wanted).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def record_counts(spark, sf):
    count = lambda n: read(spark, sf, n).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return count("customer").unionAll(count("orders")).unionAll(count("lineitem"))


@query("SELECT c_custkey AS k, max(c_acctbal) AS bal FROM (SELECT c_custkey, c_acctbal, 0 AS pri FROM customer UNION ALL SELECT c_custkey + 1000, c_acctbal, 1 FROM customer WHERE c_custkey + 1000 NOT IN (SELECT c_custkey FROM customer)) GROUP BY c_custkey")
def insert_unique(spark, sf):
    t = Store(spark).attach("c", read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), unique=("k",))
    new = t.rows.select((F.col("k") + 1000).alias("k"), "bal")
    return t.insert(new.unionAll(new), ["bal"]).rows


@query("SELECT 100 + row_number() OVER (ORDER BY p_partkey) - 1 AS rid, p_partkey, p_name FROM part")
def auto_increment(spark, sf):
    return numbered(read(spark, sf, "part").select("p_partkey", "p_name"), "rid", 100, ["p_partkey"])


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_records(spark, sf):
    return table(spark, sf, "supplier").update(F.col("s_nationkey") == 3, {"s_acctbal": F.lit(0.0)}).scan(["s_suppkey", "s_acctbal"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderstatus = 'F') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)")
def delete_records(spark, sf):
    gone = read(spark, sf, "customer").filter("c_nationkey = 1").select("c_custkey")
    return table(spark, sf, "orders").delete(F.col("o_orderstatus") == "F").delete_keys("o_custkey", gone).scan(["o_orderkey", "o_custkey"])


@query("SELECT * FROM region WHERE false")
def truncate_table(spark, sf):
    return table(spark, sf, "region").truncate().rows


@query("SELECT column_name AS name, CASE column_name WHEN 'n_name' THEN 'string' ELSE 'int' END AS kind FROM (DESCRIBE nation)")
def table_info(spark, sf):
    return spark.createDataFrame(table(spark, sf, "nation").info(), "name string, kind string")


@query("SELECT * FROM (VALUES ('nope'), ('gone')) t(missing)")
def check_fields(spark, sf):
    return spark.createDataFrame([(m,) for m in table(spark, sf, "nation").missing_fields(["n_name", "nope", "gone"])], "missing string")


@query("SELECT ((o_orderkey % 7) + 7) % 7 AS part, count(*) AS rows FROM orders GROUP BY 1")
def hash_partition_counts(spark, sf):
    return partitioning.part_counts(read(spark, sf, "orders"), "o_orderkey", 7)


@query("SELECT (CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END + CASE WHEN c_acctbal >= 2500 THEN 1 ELSE 0 END + CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END)::BIGINT AS part, count(*) AS rows FROM customer GROUP BY 1")
def range_partition_counts(spark, sf):
    return partitioning.range_counts(read(spark, sf, "customer"), "c_acctbal", [0, 2500, 5000])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 = 2")
def scan_partition(spark, sf):
    return table(spark, sf, "orders").bucket("o_orderkey", 5, 2).select("o_orderkey", "o_custkey")


@query("SELECT id, score::DOUBLE AS score, name FROM (VALUES (1, 10.5, 'a'), (2, 20.5, 'b'), (3, NULL, 'c')) t(id, score, name)")
def columns_to_rows_builder(spark, sf):
    return columns_to_rows(spark, {"id": [1, 2, 3], "score": [10.5, 20.5], "name": ["a", "b", "c", "d"]}).withColumn("id", F.col("id").cast("int"))


@query("SELECT n_nationkey, list_transform(range(n_nationkey), lambda x: 1) AS ones, list_transform(range(n_nationkey), lambda x: 0) AS zeros FROM nation")
def array_builders(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", F.array_repeat(F.lit(1), F.col("n_nationkey")).alias("ones"), F.array_repeat(F.lit(0), F.col("n_nationkey")).alias("zeros"))


@query("SELECT t AS text, d::DOUBLE AS value FROM (VALUES ('-0.5', -0.5), ('1.23456', 1.2345), ('7', 7), ('-1.99999', -1.9999), ('x', NULL)) v(t, d)")
def decimal_literals(spark, sf):
    rows = spark.createDataFrame([("-0.5",), ("1.23456",), ("7",), ("-1.99999",), ("x",)], "text string")
    return rows.select("text", types.parse(F.col("text"), "DECIMAL").cast("double").alias("value"))


@query("SELECT p_partkey, (trunc(p_retailprice * 10000) / 10000)::DOUBLE AS price, year(d) AS y, strftime(d + 40, '%Y-%m-%d') AS later FROM (SELECT p_partkey, p_retailprice, DATE '2024-02-29' + p_size AS d FROM part)")
def scalar_dates(spark, sf):
    d = F.date_add(F.lit("2024-02-29").cast("date"), F.col("p_size"))
    return read(spark, sf, "part").select("p_partkey", (F.floor(F.col("p_retailprice") * 10000) / 10000).cast("double").alias("price"), F.year(d).cast("long").alias("y"), scalars.add_days(d, 40).cast("string").alias("later"))


@query("SELECT event_id, strftime(ts + to_seconds(40000), '%H:%M:%S') AS later, (date_trunc('day', ts + to_seconds(40000))::DATE - date_trunc('day', ts)::DATE)::BIGINT AS carried FROM events")
def time_addition(spark, sf):
    later, carried = scalars.add_time(F.date_format("ts", "HH:mm:ss"), F.lit(40000))
    return read(spark, sf, "events").select("event_id", later.alias("later"), carried.alias("carried"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_fields(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT s_suppkey AS rid, s_name AS name FROM supplier UNION ALL SELECT s_suppkey + 5, min('new ' || s_name) FROM supplier WHERE s_suppkey + 5 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY s_suppkey")
def insert_at_slots(spark, sf):
    t = Table("s", read(spark, sf, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_name").alias("name")))
    new = t.rows.select((F.col("rid") + 5).alias("rid"), F.concat(F.lit("new "), "name").alias("name"))
    return t.insert_at(new.unionAll(new)).rows
