"""Queries over property graphs built from the test tables.

Vertex types: 0 customer, 1 supplier, 2 part, 3 orders. Edges: customer to order; order to
part and supplier to part with the quantity. The graph of parts links each line of an
order to the next one.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gnn, partitioning, subgraph, traverse
from ..operators.graph import PropertyGraph, neighbourhood
from ..session import written
from ..sources.generator import zipf_edges
from .registering import read, registry

QUERIES, query = registry()


def sales(spark, sf) -> PropertyGraph:
    g = PropertyGraph("sales")
    for name, key, fields in (("customer", "c_custkey", ["c_name", "c_nationkey"]), ("supplier", "s_suppkey", ["s_name"]), ("part", "p_partkey", ["p_name", "p_size"]), ("orders", "o_orderkey", ["o_totalprice"])):
        g = g.define_vertex(name, read(spark, sf, name).select(key, *fields), key)
    edges = lambda rows, a, src, b, dst, quantity: rows.select(F.lit(a).alias("src_type"), F.col(src).alias("src"), F.lit(b).alias("dst_type"), F.col(dst).alias("dst"), quantity.alias("quantity"))
    lines = read(spark, sf, "lineitem")  # two scans of few columns each take less than one that makes two rows of each
    placed = edges(read(spark, sf, "orders"), 0, "o_custkey", 3, "o_orderkey", F.lit(None).cast("double"))
    return g.insert_edges(placed.unionAll(edges(lines, 3, "l_orderkey", 2, "l_partkey", F.col("l_quantity"))).unionAll(edges(lines, 1, "l_suppkey", 2, "l_partkey", F.col("l_quantity"))), checked=False)


SALES = """WITH edges AS (
  SELECT 0 AS src_type, o_custkey AS src, 3 AS dst_type, o_orderkey AS dst, NULL::DOUBLE AS quantity FROM orders
  UNION ALL SELECT 3, l_orderkey, 2, l_partkey, l_quantity FROM lineitem
  UNION ALL SELECT 1, l_suppkey, 2, l_partkey, l_quantity FROM lineitem) """


def part_links(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.filter("dst is not null")


LINKS = """links AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""


def seeds(spark, sf, every: int):
    return read(spark, sf, "part").filter(F.col("p_partkey") % every == 1).select(F.col("p_partkey").alias("vid"))


@query("SELECT 0 AS vpid, c_custkey AS key, c_name, c_nationkey, NULL AS s_name, NULL AS p_name, NULL::INT AS p_size, NULL::DOUBLE AS o_totalprice FROM customer UNION ALL SELECT 1, s_suppkey, NULL, NULL, s_name, NULL, NULL, NULL FROM supplier UNION ALL SELECT 2, p_partkey, NULL, NULL, NULL, p_name, p_size, NULL FROM part UNION ALL SELECT 3, o_orderkey, NULL, NULL, NULL, NULL, NULL, o_totalprice FROM orders")
def vertex_list(spark, sf):
    return sales(spark, sf).vertices()


@query(SALES + "SELECT src, dst FROM edges")
def edge_list(spark, sf):
    return sales(spark, sf).edges().select("src", "dst")


@query(SALES + "SELECT 'v' || v.vpid AS what, v.n FROM (SELECT 0 AS vpid, count(*) AS n FROM customer UNION ALL SELECT 1, count(*) FROM supplier UNION ALL SELECT 2, count(*) FROM part UNION ALL SELECT 3, count(*) FROM orders) v UNION ALL SELECT 'e' || src_type || '-' || dst_type, count(*) FROM edges GROUP BY src_type, dst_type")
def graph_counts(spark, sf):
    g = sales(spark, sf)
    v = g.vertex_counts().select(F.concat(F.lit("v"), "vpid").alias("what"), F.col("vertices").alias("n"))
    return v.unionAll(g.edge_counts().select(F.concat(F.lit("e"), "src_type", F.lit("-"), "dst_type").alias("what"), F.col("edges").alias("n")))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7")
def vertex_lookup(spark, sf):
    return sales(spark, sf).vertex("supplier", 7)


@query("SELECT * FROM (VALUES (0, 5), (2, 9)) t(vpid, key)")
def vertex_exists(spark, sf):
    wanted = spark.createDataFrame([(0, 5), (1, 900000000), (2, 9), (2, -4)], "vpid int, key long")
    return sales(spark, sf).known(wanted).select("vpid", F.col("key").cast("int").alias("key"))


@query("""WITH new AS (SELECT s_suppkey + 50 AS k, 'new ' || s_name AS s_name FROM supplier), put AS (SELECT k, min(s_name) AS s_name FROM new WHERE k NOT IN (SELECT s_suppkey FROM supplier) GROUP BY k)
SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT k, s_name FROM put""")
def upsert_vertices(spark, sf):
    g = sales(spark, sf)
    new = g.types[1].rows.select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.concat(F.lit("new "), "s_name").alias("s_name"))
    return g.insert_vertices("supplier", new.unionAll(new), ["s_name"]).types[1].rows


@query(SALES + "SELECT src_type, src, dst_type, dst FROM edges WHERE src_type = 0 AND src % 3 = 0")
def dangling_edges(spark, sf):
    g = sales(spark, sf)
    small = PropertyGraph("s").define_vertex("customer", g.types[0].rows.filter("c_custkey % 3 <> 0"), "c_custkey")
    for t in g.types[1:]:
        small = small.define_vertex(t.name, t.rows, t.key)
    return small.dangling(g.edges().select("src_type", "src", "dst_type", "dst"))


@query("SELECT 0 AS type, o_custkey AS key, list_sort(list(o_orderkey)) AS neighbours FROM orders GROUP BY o_custkey UNION ALL SELECT 1, l_suppkey, list_sort(list(l_partkey)) FROM lineitem GROUP BY l_suppkey UNION ALL SELECT 3, l_orderkey, list_sort(list(l_partkey)) FROM lineitem GROUP BY l_orderkey")
def adjacency_out(spark, sf):
    return sales(spark, sf).adjacency()


@query(SALES + "SELECT dst_type AS type, dst AS key, list_sort(list(src)) AS neighbours FROM edges GROUP BY dst_type, dst")
def adjacency_in(spark, sf):
    return sales(spark, sf).adjacency(incoming=True)


@query("SELECT p_name, p_size, l_quantity AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = 7")
def adjacency_properties(spark, sf):
    return sales(spark, sf).neighbours("supplier", 7, "part", ["p_name", "p_size"])


@query("WITH " + LINKS + " SELECT src, dst FROM links WHERE src % 40 = 1 OR dst % 40 = 1")
def neighborhood_1hop(spark, sf):
    return neighbourhood(part_links(spark, sf), seeds(spark, sf, 40))


@query(SALES + "SELECT src_type, src, count(*) AS edges FROM edges GROUP BY src_type, src")
def delta_main_merge(spark, sf):
    g = sales(spark, sf)
    half = g.edges().filter("dst % 2 = 0"), g.edges().filter("dst % 2 = 1")
    out = PropertyGraph("halves", g.types).insert_edges(half[0], False).merge().insert_edges(half[1], False)
    return out.merge().edges().groupBy("src_type", "src").agg(F.count("*").alias("edges"))


@query(SALES + "SELECT src_type, src, count(*) AS edges FROM edges GROUP BY src_type, src")
def delta_merge_by_threshold(spark, sf):
    g = sales(spark, sf)
    out = PropertyGraph("parted", g.types).insert_edges(g.edges().filter("src_type <> 0"), False).merge(per_part=20000).insert_edges(g.edges().filter("src_type = 0"), False)
    return out.merge(least=10**12).edges().groupBy("src_type", "src").agg(F.count("*").alias("edges"))


@query("SELECT 0::BIGINT AS faults")
def main_order_faults(spark, sf):
    return sales(spark, sf).merge(5).order_faults()


ONE_WAY = SALES + """, out_ AS (SELECT 'out' AS way, src_type AS type, src AS key, dst AS other FROM edges WHERE src_type <> 3),
in_ AS (SELECT 'in' AS way, dst_type AS type, dst AS key, src AS other FROM edges WHERE src_type = 1 UNION ALL SELECT 'in', 3, l_orderkey, l_partkey FROM lineitem)
SELECT way, type, count(*) AS n, sum(key)::BIGINT AS keys, sum(other)::BIGINT AS others FROM (SELECT * FROM out_ UNION ALL SELECT * FROM in_) GROUP BY way, type"""


@query(ONE_WAY)
def one_way_edges(spark, sf):
    """Orders' edges only in the incoming lists (as given), customers' only in the outgoing."""
    g = sales(spark, sf)
    e = g.edges()
    out = PropertyGraph("ways", g.types).insert_edges(e.filter("src_type = 1"), False).insert_edges(e.filter("src_type = 0"), False, ignore_in=True).insert_edges(e.filter("src_type = 3"), False, only_in=True)
    sums = lambda way, rows: rows.groupBy(F.lit(way).alias("way"), "type").agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.sum("other").alias("others"))
    return sums("out", out.directed(False)).unionAll(sums("in", out.directed(True)))


INSIDE = "inside AS (SELECT src, dst FROM links WHERE src % 3 = 1 AND dst % 3 = 1), nodes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS new_id FROM (SELECT DISTINCT unnest([src, dst]) AS v FROM inside)) "


@query("WITH " + LINKS + ", " + INSIDE + "SELECT a.new_id AS src, b.new_id AS dst FROM inside JOIN nodes a ON a.v = src JOIN nodes b ON b.v = dst")
def induced_subgraph(spark, sf):
    return subgraph.induced(part_links(spark, sf), seeds(spark, sf, 3)).edges


@query("WITH " + LINKS + ", " + INSIDE + "SELECT new_id, p_name, p_size FROM nodes JOIN part ON p_partkey = v")
def subgraph_node_data(spark, sf):
    return subgraph.induced(part_links(spark, sf), seeds(spark, sf, 3)).properties(read(spark, sf, "part"), "p_partkey", ["p_name", "p_size"])


@query("WITH " + LINKS + ", " + INSIDE + "SELECT new_id, pos, CASE WHEN pos = 0 THEN p_size ELSE p_size * 2 END::DOUBLE AS value FROM nodes JOIN part ON p_partkey = v, (VALUES (0), (1)) t(pos)")
def subgraph_flattened(spark, sf):
    part = read(spark, sf, "part").withColumn("vector", F.array(F.col("p_size").cast("double"), F.col("p_size") * 2.0))
    return subgraph.induced(part_links(spark, sf), seeds(spark, sf, 3)).flattened(part, "p_partkey", "vector")


@query("SELECT 2 AS size")
def subgraph_vector_size(spark, sf):
    part = read(spark, sf, "part").withColumn("vector", F.array(F.col("p_size").cast("double"), F.col("p_size") * 2.0))
    return subgraph.induced(part_links(spark, sf), seeds(spark, sf, 3)).vector_size(part, "p_partkey", "vector")


@query(SALES + "SELECT (src_type::BIGINT << 32) + dst_type AS edge_type, count(*) AS edges FROM edges WHERE src % 2 = 0 AND dst % 2 = 0 GROUP BY 1")
def subgraph_edge_types(spark, sf):
    g = sales(spark, sf)
    return subgraph.edge_type_counts(subgraph.induced_by_type(g.edges(), g.keys().filter("key % 2 = 0"))[1])


@query(SALES + ", ends AS (SELECT DISTINCT src_type AS t, src AS k FROM edges WHERE src % 2 = 0 AND dst % 2 = 0 UNION SELECT DISTINCT dst_type, dst FROM edges WHERE src % 2 = 0 AND dst % 2 = 0) SELECT t AS vpid, k AS key, row_number() OVER (PARTITION BY t ORDER BY k) - 1 AS new_id FROM ends")
def subgraph_relabel(spark, sf):
    g = sales(spark, sf)
    return subgraph.induced_by_type(g.edges(), g.keys().filter("key % 2 = 0"))[0]


@query("WITH " + LINKS + " SELECT src % 4 AS part, count(*) AS edges, count(*) FILTER (WHERE src % 4 <> dst % 4) AS cut FROM links GROUP BY 1")
def edge_cut(spark, sf):
    return partitioning.edge_cut(part_links(spark, sf), 4)


@query("WITH " + LINKS + ", own AS (SELECT DISTINCT src % 4 AS part, src AS vid FROM links), far AS (SELECT DISTINCT src % 4 AS part, dst AS vid FROM links EXCEPT SELECT * FROM own) SELECT part, vid, false AS is_replica FROM own UNION ALL SELECT part, vid, true FROM far")
def vertex_replicas(spark, sf):
    return partitioning.vertex_cut(part_links(spark, sf), 4)


@query("WITH " + LINKS + ", e AS (SELECT (CASE WHEN dst >= 500 THEN 1 ELSE 0 END + CASE WHEN dst >= 1500 THEN 1 ELSE 0 END)::BIGINT AS part, dst AS own, src AS far FROM links), own AS (SELECT DISTINCT part, own AS vid FROM e), far AS (SELECT DISTINCT part, far AS vid FROM e EXCEPT SELECT * FROM own) SELECT part, vid, false AS is_replica FROM own UNION ALL SELECT part, vid, true FROM far")
def vertex_replicas_by_range(spark, sf):
    return partitioning.vertex_cut_range(part_links(spark, sf), [500, 1500], "dst")


CSR = LINKS + """, ids AS (SELECT p_partkey AS v, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part),
full_ AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM links JOIN ids a ON a.v = src JOIN ids b ON b.v = dst UNION SELECT id, id FROM ids),
w AS (SELECT src, dst, 1 / sqrt(count(*) OVER (PARTITION BY src) * count(*) OVER (PARTITION BY dst)) AS weight FROM full_)"""


@query("WITH " + CSR + " SELECT src, dst, round(weight, 8) AS weight FROM w")
def csr_gcn_norm(spark, sf):
    return gnn.training_edges(seeds(spark, sf, 1).unionByName(read(spark, sf, "part").select(F.col("p_partkey").alias("vid"))), part_links(spark, sf)).select("src", "dst", F.round("weight", 8).alias("weight"))


@query("WITH " + CSR + ", f AS (SELECT id, p_size::DOUBLE AS a, p_retailprice AS b FROM part JOIN ids ON v = p_partkey) SELECT dst AS id, round(sum(weight * a), 6) AS a, round(sum(weight * b), 4) AS b FROM w JOIN f ON f.id = src GROUP BY dst")
def gcn_propagation(spark, sf):
    part = read(spark, sf, "part")
    weights = gnn.training_edges(part.select(F.col("p_partkey").alias("vid")), part_links(spark, sf))
    features = gnn.numbered(part.select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("features")), "id", 0, ["p_partkey"]).select("id", "features")
    return gnn.propagated(weights, features, 2).select("id", F.round(F.col("features")[0], 6).alias("a"), F.round(F.col("features")[1], 4).alias("b"))


@query("WITH " + CSR + ", h AS (SELECT id, p_size::DOUBLE AS h FROM part JOIN ids ON v = p_partkey), z1 AS (SELECT dst AS id, 0.8 * sum(weight * h.h) + 0.2 * max(o.h) AS z FROM w JOIN h ON h.id = src JOIN h o ON o.id = dst GROUP BY dst), z2 AS (SELECT dst AS id, 0.8 * sum(weight * z) + 0.2 * max(o.h) AS z FROM w JOIN z1 ON z1.id = src JOIN h o ON o.id = dst GROUP BY dst) SELECT id, round(z, 6) AS z FROM z2")
def appnp_propagation(spark, sf):
    part = read(spark, sf, "part")
    weights = gnn.checkpointed(gnn.training_edges(part.select(F.col("p_partkey").alias("vid")), part_links(spark, sf)))
    features = gnn.numbered(part.select("p_partkey", F.array(F.col("p_size").cast("double")).alias("features")), "id", 0, ["p_partkey"]).select("id", "features")
    return gnn.appnp(weights, gnn.checkpointed(features), 1, 2, 0.2).select("id", F.round(F.col("features")[0], 6).alias("z"))


@query("WITH " + LINKS + ", e AS (SELECT src, dst, CASE WHEN s > 0 THEN s ELSE 0.02 * s END AS s FROM (SELECT DISTINCT src, dst, 0.1 * a.p_size - 0.2 * b.p_size AS s FROM links JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst)) SELECT src, dst, round(exp(s) / sum(exp(s)) OVER (PARTITION BY dst), 8) AS attention FROM e")
def gat_attention(spark, sf):
    features = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("features"))
    scores = gnn.gat_scores(part_links(spark, sf).distinct(), features, [0.1], [-0.2])
    return gnn.edge_softmax(scores, "score").select("src", "dst", F.round("attention", 8).alias("attention"))


@query()
def random_walk(spark, sf):
    return traverse.restart_walks(part_links(spark, sf), seeds(spark, sf, 100), 6, 0.2, 11)


@query()
def random_walk_subgraph(spark, sf):
    links = written(part_links(spark, sf), "links")
    sampled = traverse.walk_samples(links, seeds(spark, sf, 400), 6, 3, 0.2, 11)
    return subgraph.induced(links, sampled.select("vid")).edges


@query()
def random_walk_node_data(spark, sf):
    links = written(part_links(spark, sf), "links")
    sampled = traverse.walk_samples(links, seeds(spark, sf, 400), 6, 3, 0.2, 11)
    return subgraph.induced(links, sampled.select("vid")).properties(read(spark, sf, "part"), "p_partkey", ["p_name", "p_size"])


@query()
def neighbor_sample(spark, sf):
    return traverse.sampled_neighbours(part_links(spark, sf), seeds(spark, sf, 20), 3, 5)


@query("WITH " + LINKS + " SELECT DISTINCT src, dst FROM links WHERE src % 20 = 1 UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 20 = 1 AND p_partkey NOT IN (SELECT src FROM links)")
def neighbor_sample_all(spark, sf):
    return traverse.sampled_neighbours(part_links(spark, sf), seeds(spark, sf, 20), -1)


@query("WITH RECURSIVE " + LINKS + ", e AS (SELECT DISTINCT src, dst FROM links), walk AS (SELECT 1::BIGINT AS vid, 0 AS level UNION SELECT dst, level + 1 FROM walk JOIN e ON src = vid WHERE level < 12) SELECT vid, min(level) AS level FROM walk GROUP BY vid")
def bfs_levels(spark, sf):
    return traverse.bfs_levels(part_links(spark, sf), spark.createDataFrame([(1,)], "vid long"))


@query("WITH " + LINKS + ", e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM links WHERE src <> dst), t AS (SELECT x.a AS u, x.b AS v, y.b AS w FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) SELECT vid, count(*) AS triangles FROM (SELECT unnest([u, v, w]) AS vid FROM t) GROUP BY vid")
def triangle_count(spark, sf):
    return traverse.triangles(part_links(spark, sf))


def _rank_sql(rounds: int) -> str:
    out = "WITH " + LINKS + ", v AS (SELECT DISTINCT unnest([src, dst]) AS vid FROM links), o AS (SELECT src, count(*) AS n FROM links GROUP BY src), r0 AS (SELECT vid, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"
    for k in range(1, rounds + 1):
        lost = f"(SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE vid NOT IN (SELECT src FROM o))"
        out += f", r{k} AS (SELECT v.vid, 0.15 / (SELECT count(*) FROM v) + 0.85 * {lost} / (SELECT count(*) FROM v) + 0.85 * coalesce(p, 0) AS rank FROM v LEFT JOIN (SELECT dst AS vid, sum(rank / n) AS p FROM links JOIN r{k - 1} r ON r.vid = src JOIN o USING (src) GROUP BY dst) g USING (vid))"
    return out + f" SELECT vid, round(rank, 10) AS rank FROM r{rounds}"


@query(_rank_sql(3))
def pagerank(spark, sf):
    return traverse.pagerank(part_links(spark, sf), 3).select("vid", F.round("rank", 10).alias("rank"))


@query("WITH t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT a AS src, b AS dst, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2")
def event_transitions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return rows.filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query()
def synthetic_zipf_graph(spark, sf):
    return zipf_edges(spark).groupBy("src").agg(F.count("*").alias("edges"))
