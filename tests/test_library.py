"""Hand-checked cases: tables, types, graphs, lineage, evaluation, archives, streams."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strataform.functions import scalars, types
from strataform.operators import evaluation, gnn, lineage, partitioning, profiles, subgraph, traverse, versions
from strataform.operators.graph import GraphError, PropertyGraph
from strataform.operators.running import running_max, running_totals
from strataform.operators.tables import Store, Table, TableError, numbered
from strataform.session import NoSharedFolder, shared_dir
from strataform.sources import archive, text_tables
from strataform.streaming import compaction

EDGES = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (4, 5)]


def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "vid long")


def test_csv_with_lists_and_odd_values(spark, tmp_path):
    (tmp_path / "t.schema").write_text("id,BIGINT\nok,BOOL\nprice,DECIMAL\nday,DATE\nxs,LONGLIST\n")
    (tmp_path / "t.csv").write_text('id,ok,price,day,xs\n1,True,-0.5,2024-02-29,"[1,2]"\n2,False,1.23456,2024-13-01,"[]"\n3,maybe,x,2023-02-29,"[7]"\n')
    store = Store(spark)
    t = store.load("t", str(tmp_path / "t.schema"), str(tmp_path / "t.csv"))
    got = [tuple(str(v) for v in r) for r in t.rows.orderBy("id").collect()]
    assert got == [("1", "True", "-0.5000", "2024-02-29", "[1, 2]"), ("2", "False", "1.2345", "None", "[]"), ("3", "None", "None", "None", "[7]")]
    assert [r.ok for r in t.scan_text(["ok"]).collect()] == ["True", "False", None]
    (tmp_path / "bad.schema").write_text("id,BIGINT,x\n")
    with pytest.raises(ValueError):
        store.create_from_file("bad", str(tmp_path / "bad.schema"))
    with pytest.raises(TableError):
        store.create_from_file("t", str(tmp_path / "t.schema"))
    store.drop("t")
    with pytest.raises(TableError):
        store.drop("t")
    store.drop("t", if_exists=True)


def test_inserts(spark):
    store = Store(spark)
    t = store.create("k", [("id", "BIGINT"), ("v", "VARCHAR")], running="id", start=5)
    t = t.insert(spark.createDataFrame([("b",), ("a",)], "v string"))
    t = t.insert(spark.createDataFrame([("c",)], "v string"))
    assert sorted(map(tuple, t.rows.collect())) == [(5, "a"), (6, "b"), (7, "c")]
    u = store.create("u", [("id", "BIGINT"), ("v", "VARCHAR")]).with_index(0, unique=True)
    u = u.insert(spark.createDataFrame([(1, "old")], "id long, v string"))
    u = u.insert(spark.createDataFrame([(1, "new"), (2, "z"), (2, "y")], "id long, v string"), ["v"])
    assert sorted(map(tuple, u.rows.collect())) == [(1, "old"), (2, "y")]
    assert u.lookup(0, 2).count() == 1 and u.lookup("v", "y").count() == 0
    with pytest.raises(TableError):
        u.insert(spark.createDataFrame([(1,)], "id long"))


def test_decimals(spark):
    one = spark.createDataFrame([("-7.5", "2.0001"), ("1.0000", "3")], "a string, b string").select(types.decimal(F.col("a")).alias("a"), types.decimal(F.col("b")).alias("b"))
    got = one.select(types.decimal_multiply(F.col("a"), F.col("b")).cast("string").alias("m"), types.decimal_divide(F.col("a"), F.col("b")).cast("string").alias("d")).collect()
    assert [tuple(r) for r in got] == [("-15.0007", "-3.7498"), ("3.0000", "0.3333")]
    assert one.select(types.decimal_divide(F.col("a"), F.lit(0)).alias("d")).filter("d is not null").count() == 0


def test_running_totals_and_numbers_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id")).repartition(5)
    got = {(r.g, r.id): r.t for r in running_totals(df, ["g"], ["id"], {"t": F.col("id")}).collect()}
    for g in (0, 1):
        total = 0
        for i in sorted(i for h, i in got if h == g):
            total += i
            assert got[g, i] == total
    many = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("id"), F.lit(0).alias("g")).repartition(7)
    rows = running_max(running_totals(many, ["g"], ["id"], {"t": F.lit(1)}), ["g"], ["id"], {"m": F.col("t")})
    assert rows.filter("t <> id + 1 or m <> t").isEmpty() and numbered(many, "n", 5, ["id"]).filter("n <> id + 5").isEmpty()
    assert [r.n for r in numbered(df, "n", 10, ["id"]).orderBy("id").collect()] == list(range(10, 1010))


def test_running_totals_keep_rows_whose_group_is_null(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("a", 4)], "g string, id int").repartition(3)
    assert sorted((r.id, r.t) for r in running_totals(df, ["g"], ["id"], {"t": F.col("id")}).collect()) == [(1, 1), (2, 2), (3, 4), (4, 6)]
    assert sorted((r.id, r.t) for r in running_max(df, ["g"], ["id"], {"t": -F.col("id")}).collect()) == [(1, -1), (2, -2), (3, -1), (4, -2)]


def test_graph_counts_upserts_and_ends(spark):
    a = spark.createDataFrame([(k, f"a{k}") for k in range(1, 7)], "id long, name string")
    g = PropertyGraph("g").define_vertex("a", a, "id").define_vertex("b", a.limit(0), "id")
    new = spark.createDataFrame([(1, "other"), (9, "z"), (9, "y")], "id long, name string")
    g = g.insert_vertices("b", new, ["name"]).insert_vertices("a", new, ["name"])
    assert {r.vpid: r.vertices for r in g.vertex_counts().collect()} == {0: 7, 1: 2}
    assert g.vertex("a", 1).first().name == "a1" and g.vertex("b", 9).first().name == "y" and g.vertex("a", 77).isEmpty()
    e = edges(spark).select(F.lit(0).alias("src_type"), "src", F.lit(0).alias("dst_type"), "dst").union(spark.createDataFrame([(0, 1, 1, 77)], "a int, b long, c int, d long"))
    assert [tuple(r) for r in g.dangling(e).collect()] == [(0, 1, 1, 77)]
    g = g.insert_edges(e)
    assert g.edges().count() == 6 and g.merge().insert_edges(e).edges().count() == 12
    assert {(r.key): r.neighbours for r in g.adjacency().collect()}[1] == [2, 2, 3]
    with pytest.raises(GraphError):
        PropertyGraph("n", incoming=False).insert_edges(e, False).adjacency(incoming=True)


def test_induced_subgraph(spark):
    s = subgraph.induced(edges(spark), ids(spark, 1, 2, 3, 6, 6))
    assert s.nodes.count() == 3 and sorted(map(tuple, s.edges.collect())) == [(0, 1), (0, 1), (0, 2), (1, 2), (2, 0)]


def test_traversals(spark):
    e = edges(spark)
    assert {r.vid: r.level for r in traverse.bfs_levels(e, ids(spark, 2)).collect()} == {2: 0, 3: 1, 1: 2}
    assert {r.vid: r.triangles for r in traverse.triangles(e).collect()} == {1: 1, 2: 1, 3: 1}
    ranks = {r.vid: r.rank for r in traverse.pagerank(e, 5).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[3] > ranks[4]
    near = traverse.sampled_neighbours(e, ids(spark, 1, 6), 1, 3).collect()
    assert sorted(r.src for r in near) == [1, 6] and [r.dst for r in near if r.src == 6] == [6]
    known = set(EDGES)
    walks = traverse.restart_walks(e, ids(spark, 1, 4, 6), 8, 0.3, 1).orderBy("walk", "step").collect()
    for a, b in zip(walks, walks[1:]):
        if a.walk == b.walk:
            assert (a.vid, b.vid) in known or b.vid == b.walk


def test_training_edges(spark):
    w = {(r.src, r.dst): r.weight for r in gnn.training_edges(ids(spark, *range(1, 7)), edges(spark)).collect()}
    assert len(w) == 5 + 6 and abs(w[5, 5] - 1) < 1e-12 and abs(w[0, 1] - 1 / (3 * 2) ** 0.5) < 1e-12


def test_versions_and_filters(spark):
    members = spark.createDataFrame([("a", 0, 5), ("a", 1, 7), ("b", 0, 7)], "version string, pos long, item long")
    assert [r.item for r in versions.merged(members, ["b", "a"], "c").orderBy("pos").collect()] == [7, 5, 7]
    items, notes = spark.createDataFrame([(5,), (7,)], "k long"), spark.createDataFrame([(5, "x")], "k long, label string")
    assert versions.filtered(items, notes, "k", "label", ids=[5, 7], with_unannotated=True).count() == 2
    with pytest.raises(versions.VersionError):
        versions.filtered(items, notes, "k", "label")


def test_average_precision_by_hand(spark):
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    truth = spark.createDataFrame([("i", "c", 1, (0.0, 0.0, 10.0, 10.0)), ("j", "c", 2, (0.0, 0.0, 10.0, 10.0)), ("j", "d", 3, (0.0, 0.0, 1.0, 1.0))], f"item string, label string, box_id long, box {box}")
    found = spark.createDataFrame([("i", "c", 1, 0.9, (0.0, 0.0, 10.0, 10.0)), ("i", "c", 2, 0.8, (1.0, 0.0, 10.0, 10.0)), ("j", "c", 3, 0.7, (0.0, 0.0, 10.0, 9.0))], f"item string, label string, det long, score double, box {box}")
    got = {r.label: r.ap for r in evaluation.average_precision(truth, found, [0.5]).collect()}
    assert got["d"] == 0 and abs(got["c"] - (1 / 2 + 2 / 3 / 2)) < 1e-12
    coco = {r.label: r.ap for r in evaluation.average_precision(truth, found, [0.5], 101).collect()}
    assert abs(coco["c"] - (51 * 1 + 50 * 2 / 3) / 101) < 1e-12


def test_lineage_merges_and_paths(spark):
    n = spark.createDataFrame([("D", "1", {"v": "1"}), ("D", "1", {"v": "1"}), ("T", "1", {}), ("M", "1", {})], lineage.NODES)
    h = lineage.Lineage.empty(spark).merge_nodes(n).merge_nodes(n)
    pairs = spark.createDataFrame([("1", "1"), ("1", "gone")], "src string, dst string")
    twice = h.create_edges("X", "D", "T", pairs).create_edges("X", "D", "T", pairs)
    once = h.create_edges("X", "D", "T", pairs, once=True).create_edges("X", "D", "T", pairs, once=True).create_edges("X", "M", "T", pairs, once=True)
    assert (h.nodes.count(), twice.edges.count(), once.edges.count()) == (3, 2, 2)
    assert h.exists("D", v="1") and not h.exists("D", v="2")
    assert [tuple(r) for r in once.step(once.start("D"), "X").collect()] == [("D", "1", "T", "1")]
    left = once.detach(spark.createDataFrame([("D", "1")], "label string, id string"))
    assert [r.src_label for r in left.edges.collect()] == ["M"] and {r.label for r in left.nodes.collect()} == {"T", "M"}
    assert once.detach(spark.createDataFrame([("T", "1")], "label string, id string")).edges.isEmpty()


def test_archive_round_trip(spark, tmp_path):
    tables = {"e": edges(spark), "n": spark.createDataFrame([(1, [1.5])], "k int, f array<double>")}
    archive.archive(tables, str(tmp_path / "a"), {"n": {"layout": "ROW"}})
    back, kinds = archive.recover(spark, str(tmp_path / "a"))
    assert kinds["n"] == {"layout": "ROW"} and back["n"].schema == tables["n"].schema
    assert sorted(back["e"].collect()) == sorted(tables["e"].collect())


def test_graph_folder(spark, tmp_path):
    for name, text in (("node-label", "3\n4\n"), ("node_year", "2001\n2002\n"), ("node-feat", "1.0,2.0\n3.0,4.0\n"), ("edge", "0,1\n1,0\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    v, e = text_tables.read_graph_folder(spark, str(tmp_path))
    assert sorted(map(tuple, v.collect())) == [(0, 3, 2001, [1.0, 2.0]), (1, 4, 2002, [3.0, 4.0])] and e.count() == 2


def test_stream_of_edges_is_folded_once(spark, tmp_path):
    edges(spark).repartition(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        compaction.ingest_edges(stream, str(tmp_path / "main"), str(tmp_path / "check")).awaitTermination()
    out = compaction.compact(spark, str(tmp_path / "main"), str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == sorted(EDGES)


def test_late_events_are_dropped(spark, tmp_path):
    """The watermark stands at 12:30 after the first file, so the event of the day before in
    the second is late, while the one an hour back in an open window counts."""
    kind = "ts string, event_type string"
    batches = [[("2024-03-01 01:00:00", "a"), ("2024-03-02 13:30:00", "a")], [("2024-03-01 23:59:00", "a"), ("2024-03-02 12:40:00", "a"), ("2024-03-02 13:40:00", "b")], [("2024-03-05 00:00:00", "c")]]
    (tmp_path / "in").mkdir()
    counted = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).selectExpr("ts::timestamp AS ts", "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
        keep = lambda df, n: counted.update({(str(r.start), r.event_type): r.n for r in df.collect()})
        compaction.event_counts(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert counted == {("2024-03-01 00:00:00", "a"): 1, ("2024-03-02 00:00:00", "a"): 2, ("2024-03-02 00:00:00", "b"): 1, ("2024-03-05 00:00:00", "c"): 1}


def test_graphs_without_edges_and_with_other_properties(spark):
    none = PropertyGraph("none")
    assert none.keys().isEmpty() and none.vertices().isEmpty() and none.edge_counts().isEmpty() and none.adjacency().isEmpty() and none.merge().order_faults().first()[0] == 0
    a = spark.createDataFrame([(k,) for k in range(6)], "id long")
    g = PropertyGraph("g").define_vertex("a", a, "id")
    rows = edges(spark).filter("src < 5 and dst < 5").selectExpr("0 AS src_type", "src", "0 AS dst_type", "dst")
    g = g.insert_edges(rows.withColumn("w", F.lit(1))).merge().insert_edges(rows.withColumn("c", F.lit("x")))
    assert g.edge_fields == ("w", "c") and g.edges().count() == 10 and g.edges().filter("w is null and c = 'x'").count() == 5
    assert g.merge().edges().count() == 10 and g.truncate().edges().isEmpty() and g.truncate().info()["vertices"] == g.info()["vertices"]
    few = g.merge(least=6)
    assert few.main is g.main and few.delta is not None and g.merge(least=5).delta.isEmpty()
    assert PropertyGraph("o", incoming=False).insert_edges(rows, False, only_in=True).edges().isEmpty()


def test_order_faults_are_found(spark, tmp_path):
    rows = spark.createDataFrame([(0, k % 7, 0, k) for k in range(40)], "src_type int, src long, dst_type int, dst long")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.filter("src < 4").coalesce(1).sortWithinPartitions("src", "dst").write.parquet(str(tmp_path / "two"))
    rows.filter("src > 2").coalesce(1).sortWithinPartitions("src", "dst").write.mode("append").parquet(str(tmp_path / "two"))
    main = lambda name: PropertyGraph("g", main=spark.read.parquet(str(tmp_path / name)))
    assert main("one").order_faults().first()[0] == 5 and main("two").order_faults().first()[0] == 1
    assert PropertyGraph("g").insert_edges(rows, False).merge(3).order_faults().first()[0] == 0


def test_walk_samples(spark):
    e = edges(spark)
    got = {}
    for r in traverse.walk_samples(e, ids(spark, 1, 4, 6), 4, 3, 0.1, 5).collect():
        got.setdefault(r.start, set()).add(r.vid)
    assert {1} < got[1] <= {1, 2, 3} and len(got[1]) == 3 and got[4] <= {4, 5} and got[6] == {6}
    placed, degrees = traverse.indexed(e.union(e))
    seen = {}
    for r in placed.collect():
        seen.setdefault(r.src, []).append((r.place, r.dst))
    assert {k: [d for _, d in sorted(v)] for k, v in seen.items()} == {1: [2, 2, 2, 2, 3, 3], 2: [3, 3], 3: [1, 1], 4: [5, 5]}
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in seen.values()) and {r.src: r.degree for r in degrees.collect()}[1] == 6


def test_sampled_neighbours_by_fanout(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(300)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = {}
    for r in traverse.sampled_neighbours(e, ids(spark, *range(0, 40, 2)), 4, 9).collect():
        got.setdefault(r.src, []).append(r.dst)
    for v in range(0, 40, 2):
        own = {d for s, d in pairs if s == v}
        assert len(got[v]) == len(set(got[v])) == max(1, min(4, len(own))) and set(got[v]) <= (own or {v})


def test_lines_are_numbered_across_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        (tmp_path / "f.csv").write_text("".join(f"line {k}\n" for k in range(2000)))
        got = text_tables.numbered_lines(spark, str(tmp_path / "f.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.line: r.text for r in got} == {k: f"line {k}" for k in range(2000)}


def test_edge_balanced_splits(spark):
    e = spark.range(10000).selectExpr("id * id % 997 AS src", "id AS dst")
    splits = partitioning.edge_balanced_splits(e, 4)
    sizes = [r.rows for r in partitioning.range_counts(e, "src", splits).collect()]
    assert len(sizes) == 4 and max(sizes) < 2900


def test_predictions_and_profiles(spark):
    images = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, "a", None)], "k long, name string, fps double")
    found = spark.createDataFrame([(1, "x", "object", 1), (1, "y", "line", 2), (3, "x", "object", 3)], "k long, label string, kind string, n int")
    assert versions.filtered_predictions(images, found, "k", "name", "label", "a , c", "x").count() == 2
    assert versions.filtered_predictions(images, found, "k", "name", "label", None, None, False).count() == 4
    assert {r.name: [p.n for p in r.predictions] for r in versions.regrouped_by_name(images, found, "k", "name", ["n"]).collect()} == {"a": [1, 2, 3], "b": []}
    assert tuple(profiles.predict_profile(images, found, "k", "kind", "fps").first()) == (3, 1, 2, 2 / 3, 15.0)
    assert evaluation.mean_fps(images.limit(0)).first().fps == 0
    taken = spark.createDataFrame([(0, "a"), (2, "b")], "rid long, v string")
    assert sorted(map(tuple, Table("t", taken).insert_at(spark.createDataFrame([(1, "c"), (1, "b"), (2, "z")], "rid long, v string")).rows.collect())) == [(0, "a"), (1, "b"), (2, "b")]


def test_propagation_of_wide_features(spark):
    weights = spark.createDataFrame([(0, 1, 0.5), (2, 1, 2.0), (1, 0, 1.0)], "src long, dst long, weight double")
    features = spark.range(3).selectExpr("id", "transform(sequence(1, 1500), x -> double(x * id)) AS features")
    got = {r.id: r.features for r in gnn.propagated(weights, features, 1500).collect()}
    assert got[1] == [4.0 * x for x in range(1, 1501)] and got[0] == [1.0 * x for x in range(1, 1501)]


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(NoSharedFolder):
        shared_dir(Session)


def test_scalars(spark):
    row = spark.createDataFrame([("23:59:30", "lr0.01epochs20bsize64", "a_b")], "t string, plan string, name string")
    t, days = scalars.add_time(F.col("t"), F.lit(45))
    got = row.select(t.alias("t"), days.alias("d"), *[c.alias(k) for k, c in scalars.plan_fields(F.col("plan")).items()], scalars.name_parts(F.col("name"), ["x", "y", "z"])["z"].alias("z")).first()
    assert tuple(got) == ("00:00:15", 1, 0.01, 20, 64, None)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
