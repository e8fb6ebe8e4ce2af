"""Queries over dataset versions, annotations, profiles, evaluation and lineage.

Orders and lineitems stand for images and annotations, documents and labels for datasets
with partly annotated items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evaluation, lineage, profiles, versions
from ..operators.running import running_totals
from ..operators.tables import first_per_key
from .registering import read, registry

QUERIES, query = registry()


@query("SELECT quality AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_profile(spark, sf):
    return profiles.label_profile(read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id"), "quality")


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE source = 'src1'")
def union_distinct_versions(spark, sf):
    a = read(spark, sf, "labels").select(F.col("doc_id").alias("item"))
    b = read(spark, sf, "documents").filter("source = 'src1'").select(F.col("doc_id").alias("item"))
    return versions.union_distinct(a, b).withColumnRenamed("item", "doc_id")


def members(spark, sf):
    docs = read(spark, sf, "documents")
    a = docs.filter("doc_id % 3 = 0").select(F.lit("v1").alias("version"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("item"))
    b = docs.filter("doc_id % 2 = 0").select(F.lit("v2").alias("version"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("item"))
    return a.unionAll(b)


@query("SELECT 'v3' AS version, row_number() OVER (ORDER BY t, doc_id) - 1 AS pos, doc_id AS item FROM (SELECT 0 AS t, doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 1, doc_id FROM documents WHERE doc_id % 2 = 0)")
def merge_versions(spark, sf):
    return versions.merged(members(spark, sf), ["v1", "v2"], "v3")


@query("SELECT version, count(*) AS n, max(pos) AS last FROM (SELECT 'v1' AS version, doc_id AS pos FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'v2', doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'v1', (SELECT max(doc_id) FROM documents WHERE doc_id % 3 = 0) + 1 + doc_id FROM documents WHERE doc_id < 10) GROUP BY version")
def delta_version(spark, sf):
    new = read(spark, sf, "documents").filter("doc_id < 10").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("item"))
    return versions.appended(members(spark, sf), "v1", new).groupBy("version").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query("SELECT doc_id AS pos, doc_id, lang, source FROM documents WHERE doc_id % 3 = 0")
def version_items(spark, sf):
    return versions.items_of(members(spark, sf), "v1", read(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE quality IN (1)")
def filter_version(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    return versions.filtered(docs.select("doc_id", "lang"), labels.select("doc_id", "quality"), "doc_id", "quality", labels=[1])


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id IN (1, 2, 3, 5, 8, 13)")
def filter_version_with_unannotated(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    return versions.filtered(docs.select("doc_id", "lang"), labels.select("doc_id", "quality"), "doc_id", "quality", ids=[1, 2, 3, 5, 8, 13], with_unannotated=True)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def annotated_items(spark, sf):
    return versions.annotated(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unannotated_items(spark, sf):
    return versions.unannotated(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels"), "doc_id")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first_wins(spark, sf):
    return versions.distinct_items(read(spark, sf, "documents").select("text", "doc_id"), "text", ["doc_id"])


@query("SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def group_annotations(spark, sf):
    rows = versions.grouped_annotations(read(spark, sf, "lineitem"), "l_orderkey", ["l_partkey"], "l_linenumber")
    return rows.select("l_orderkey", F.transform("annotations", lambda a: a["l_partkey"]).alias("parts"))


@query("SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY 1")
def distinct_categories(spark, sf):
    return versions.categories(read(spark, sf, "documents"), "source", "doc_id")


@query("SELECT o_orderkey, l_linenumber, l_quantity, o_totalprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def items_with_annotations(spark, sf):
    return read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity", "o_totalprice")


DECODED = "SELECT l_orderkey AS rid, l_linenumber AS annot_id, CASE WHEN l_linenumber % 2 = 0 THEN 0.25::DOUBLE END AS xmin, CASE WHEN l_linenumber % 2 = 0 THEN 0.75::DOUBLE END AS ymax, CASE WHEN l_linenumber % 2 = 1 THEN trunc(0.25 * 640)::INT END AS x0, CASE WHEN l_linenumber % 2 = 1 THEN trunc(0.75 * 481)::INT END AS y1 FROM lineitem"


def decoded(lines):
    """Each lineitem's box as an annotation of its order."""
    notes = lines.select(F.col("l_orderkey").alias("rid"), F.col("l_linenumber").alias("annot_id"), F.lit("x").alias("label"), F.when(F.col("l_linenumber") % 2 == 0, "object").otherwise("line").alias("kind"), F.array(*[F.lit(v) for v in (0.25, 0.5, 0.5, 0.75)]).alias("values"))
    items = lines.select(F.col("l_orderkey").alias("rid"), F.lit(640).alias("width"), F.lit(481).alias("height")).distinct()
    out = versions.boxes(items, notes, "rid")
    return out.select("rid", "annot_id", "xmin", "ymax", F.get("points", F.lit(0))["x"].alias("x0"), F.get("points", F.lit(1))["y"].alias("y1"))


@query(DECODED)
def decode_annotations(spark, sf):
    return decoded(read(spark, sf, "lineitem"))


STAMPED = "SELECT event_id, user_id, value AS score, date_trunc('second', ts) AS stamp FROM events"


def stamped(events):
    """Events as predictions for themselves, with the times that their file names give."""
    found = events.select("event_id", F.col("value").alias("score"), F.date_format("ts", "yyyyMMdd_HHmmss_000000").alias("stamp"))
    return versions.predictions_of(events.select("event_id", "user_id"), found, "event_id").withColumn("stamp", F.col("stamp").cast("timestamp_ntz"))


@query(STAMPED)
def predictions_with_stamps(spark, sf):
    return stamped(read(spark, sf, "events"))


@query("SELECT count(*) AS images, count(*) FILTER (WHERE n IS NULL) AS without, coalesce(sum(o), 0)::BIGINT AS objects, coalesce(sum(n), 0) / count(*) AS per_image FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS o FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) ON l_orderkey = o_orderkey")
def version_profile(spark, sf):
    notes = read(spark, sf, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "N", "object").otherwise("line").alias("kind"))
    return profiles.version_profile(read(spark, sf, "orders"), notes, "o_orderkey", "kind")


PREDICTED = "(SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS o FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)"


def predicted(spark, sf):
    """Orders as images, later lineitems as predictions."""
    images = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("fps"), F.col("o_orderpriority").alias("name"))
    found = read(spark, sf, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("number"), F.when(F.col("l_returnflag") == "N", "object").otherwise("line").alias("kind"))
    return images, found


@query(f"SELECT count(*) AS images, count(*) FILTER (WHERE o IS NULL) AS without, coalesce(sum(o), 0)::BIGINT AS objects, coalesce(sum(o), 0) / count(*) AS per_image, round(avg(o_totalprice), 4) AS fps FROM orders LEFT JOIN {PREDICTED} ON l_orderkey = o_orderkey")
def predict_profile(spark, sf):
    return profiles.predict_profile(*predicted(spark, sf), "o_orderkey", "kind", "fps").withColumn("fps", F.round("fps", 4))


@query("SELECT label, n FROM (SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1 UNION ALL SELECT 'none', 0)")
def predict_label_counts(spark, sf):
    found = predicted(spark, sf)[1]
    categories = found.select("label").distinct().unionAll(spark.createDataFrame([("none",)], "label string"))
    return profiles.label_counts(categories, found, "label")


@query("SELECT o_orderkey, name, label, number FROM (SELECT o_orderkey, o_orderpriority AS name FROM orders) JOIN (SELECT l_orderkey, l_returnflag AS label, l_linenumber AS number FROM lineitem WHERE l_linenumber > 2) ON l_orderkey = o_orderkey WHERE name IN ('1-URGENT', '5-LOW') AND label IN ('N', 'R')")
def filtered_predictions(spark, sf):
    images, found = predicted(spark, sf)
    return versions.filtered_predictions(images, found, "o_orderkey", "name", "label", " 1-URGENT, 5-LOW", "N,R ").select("o_orderkey", "name", "label", "number")


@query("SELECT o_orderkey, label FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag AS label FROM lineitem WHERE l_linenumber > 2) ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def filtered_predictions_with_unpredicted(spark, sf):
    images, found = predicted(spark, sf)
    return versions.filtered_predictions(images, found, "o_orderkey", "name", "label", "1-URGENT", None, False).select("o_orderkey", "label")


@query("SELECT o_clerk AS name, list_filter(list(l_partkey ORDER BY l_partkey), lambda x: x IS NOT NULL) AS parts FROM (SELECT o_orderkey, 'c' || o_custkey AS o_clerk FROM orders) LEFT JOIN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 2) ON l_orderkey = o_orderkey GROUP BY 1")
def predictions_by_name(spark, sf):
    images = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("name"))
    found = read(spark, sf, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    rows = versions.regrouped_by_name(images, found, "o_orderkey", "name", ["l_partkey"])
    return rows.select("name", F.transform("predictions", lambda p: p["l_partkey"]).alias("parts"))


@query("SELECT round(avg(value), 6) AS fps FROM events")
def mean_fps(spark, sf):
    return evaluation.mean_fps(read(spark, sf, "events"), "value").select(F.round("fps", 6).alias("fps"))


@query("SELECT 'Data_Version' AS label, s_nationkey::VARCHAR AS id FROM supplier UNION SELECT 'Model_Version', (s_suppkey % 9)::VARCHAR FROM supplier UNION SELECT 'Training_Version', s_suppkey::VARCHAR FROM supplier UNION SELECT 'Inference_Version', s_suppkey::VARCHAR FROM supplier")
def lineage_catalog(spark, sf):
    h = history(spark, sf)
    out = h.select(lineage.DATA).select("label", "id")
    for label in (lineage.MODEL, lineage.TRAINING, lineage.INFERENCE):
        out = out.unionAll(h.select(label).select("label", "id"))
    return out


@query("SELECT (SELECT count(*) FROM embeddings) AS nodes, (SELECT count(DISTINCT label) FROM embeddings) AS classes, (SELECT list_sort(list(DISTINCT label)) FROM embeddings) AS labels, (SELECT list_sort(list(DISTINCT vec_id % 4)) FROM embeddings) AS years, (SELECT count(*) FROM labels) AS edges")
def graph_profile(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 4).alias("year"))
    return profiles.graph_profile(v, read(spark, sf, "labels"), "label", "year")


@query("SELECT o_orderpriority, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 0 END) AS accuracy FROM orders GROUP BY 1")
def accuracy_by_label(spark, sf):
    rows = read(spark, sf, "orders").withColumn("guess", F.lit("F"))
    return evaluation.accuracy(rows, "o_orderstatus", "guess", "o_orderpriority")


@query("SELECT count(*) AS n, avg(CASE WHEN quality = (n_chars > 500)::INT THEN 100.0 ELSE 0 END) AS accuracy FROM documents JOIN labels USING (doc_id)")
def accuracy_overall(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").withColumn("guess", (F.col("n_chars") > 500).cast("int"))
    return evaluation.accuracy(rows, "quality", "guess")


@query("SELECT count(*) AS n, avg(CASE WHEN a.f = b.f THEN 100.0 ELSE 0 END) AS accuracy FROM (SELECT l_orderkey, (list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag))[1] AS f FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, (list(l_returnflag ORDER BY l_linenumber DESC, l_partkey DESC, l_returnflag))[1] AS f FROM lineitem GROUP BY 1) b USING (l_orderkey)")
def first_label_accuracy(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("name"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("place"), F.col("l_returnflag").alias("label"))
    return evaluation.first_label_accuracy(lines, lines.withColumn("place", -F.col("place")), "name", "place")


@query("SELECT round(avg(value), 6) AS fps FROM events WHERE event_id > (SELECT min(event_id) FROM events)")
def mean_fps_without_first(spark, sf):
    return evaluation.mean_fps_without_first(read(spark, sf, "events").withColumn("fps", F.col("value")), "event_id").select(F.round("fps", 6).alias("fps"))


def all_boxes(spark, sf):
    """Truth and detections made from lineitems: shifted boxes with deterministic scores. Two
    lineitems may differ in nothing but their dates, so those end a box's number."""
    lines = read(spark, sf, "lineitem")
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    box = lambda dx, dy: F.struct((x + dx).alias("xmin"), (y + dy).alias("ymin"), (x + dx + 20).alias("xmax"), (y + dy + 20).alias("ymax"))
    number = (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")) * 100000 + F.unix_date(F.to_date("l_shipdate"))
    keys = [F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("label")]
    truth = lines.select(*keys, number.alias("box_id"), box(F.lit(0.0), F.lit(0.0)).alias("box"))
    shift = (F.col("l_linenumber") % 4).cast("double") * 2.5
    score = F.pmod(F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729, F.lit(1000)) / 1000.0
    return truth, lines.select(*keys, number.alias("det"), score.alias("score"), box(shift, F.lit(0.0)).alias("box"))


HITS = """WITH l AS (SELECT l_orderkey AS item, l_returnflag AS label, (l_partkey * 100000 + l_suppkey * 10 + l_linenumber) * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS id, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, (l_linenumber % 4) * 2.5::DOUBLE AS s, ((l_partkey * 7919 + l_suppkey * 104729) % 1000) / 1000.0::DOUBLE AS score FROM lineitem),
pairs AS (SELECT d.item, d.label, d.id AS det, d.score, t.id AS box_id, greatest(0.0, least(d.x + d.s + 20, t.x + 20) - greatest(d.x + d.s, t.x)) * greatest(0.0, least(d.y + 20, t.y + 20) - greatest(d.y, t.y)) AS i FROM l d JOIN l t ON t.item = d.item AND t.label = d.label),
best AS (SELECT item, label, det, score, box_id, i / (800.0 - i) AS iou FROM pairs QUALIFY row_number() OVER (PARTITION BY item, label, det ORDER BY i / (800.0 - i) DESC, box_id) = 1),
cuts(threshold) AS (VALUES {overlaps}),
hits AS (SELECT threshold, label, item, det, score, iou >= threshold AND row_number() OVER (PARTITION BY threshold, item, label, box_id, iou >= threshold ORDER BY score DESC, det) = 1 AS hit FROM best, cuts)"""
HALF = "(0.5::DOUBLE)"
TENTHS = ", ".join(f"({0.5 + 0.05 * k:.2f}::DOUBLE)" for k in range(10))


@query(HITS.format(overlaps=HALF) + " SELECT label, item, det, hit FROM hits")
def detection_hits(spark, sf):
    return evaluation.detections(*all_boxes(spark, sf), [0.5]).select("label", "item", "det", "hit")


CURVE = """, curve AS (SELECT threshold, label, sum(hit::INT) OVER w AS tp, sum(hit::INT) OVER w / count(*) OVER w AS p FROM hits WINDOW w AS (PARTITION BY threshold, label ORDER BY score DESC, item, det ROWS UNBOUNDED PRECEDING)),
steps AS (SELECT threshold, label, tp, max(p) AS p FROM curve WHERE tp > 0 GROUP BY threshold, label, tp), tops AS (SELECT threshold, label, tp, max(p) OVER (PARTITION BY threshold, label ORDER BY tp DESC) AS best FROM steps), n AS (SELECT label, count(*) AS n FROM l GROUP BY label)"""


@query(HITS.format(overlaps=HALF) + CURVE + " SELECT 0.5::DOUBLE AS threshold, label, round(sum(best / n), 8) AS ap FROM tops JOIN n USING (label) GROUP BY label")
def average_precision(spark, sf):
    return evaluation.average_precision(*all_boxes(spark, sf), [0.5]).select("threshold", "label", F.round("ap", 8).alias("ap"))


@query(HITS.format(overlaps=TENTHS) + CURVE + """, voc AS (SELECT label, sum(best / n) AS ap FROM tops JOIN n USING (label) WHERE threshold = 0.5 GROUP BY label),
points AS (SELECT threshold, label, k, n FROM cuts, n, range(101) r(k)),
at_points AS (SELECT threshold, label, k, coalesce(max(best), 0) AS p FROM points LEFT JOIN tops USING (threshold, label) WHERE tp IS NULL OR tp * 100 >= k * n GROUP BY threshold, label, k)
SELECT round((SELECT sum(ap) FROM voc) / (SELECT count(*) FROM n), 8) AS voc, round(100 * (SELECT sum(p) FROM at_points) / 101 / (SELECT count(*) * 10 FROM n), 6) AS coco""")
def mean_average_precision(spark, sf):
    return evaluation.mean_average_precision(*all_boxes(spark, sf)).select(F.round("voc", 8).alias("voc"), F.round("coco", 6).alias("coco"))


@query("SELECT CASE WHEN hour(ts) BETWEEN 5 AND 19 THEN 'daytime' ELSE 'nighttime' END AS part, count(*) AS n FROM events GROUP BY 1")
def daypart(spark, sf):
    return read(spark, sf, "events").groupBy(scalars.daypart(F.col("ts")).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|brass') THEN 'metal' WHEN regexp_matches(lower(p_type), 'tin') THEN 'tin' ELSE 'other' END AS kind, list_filter([CASE WHEN regexp_matches(lower(p_name), 'a') THEN 'has-a' END, CASE WHEN regexp_matches(lower(p_name), '[0-9]+') THEN 'number' END], lambda x: x IS NOT NULL) AS tags FROM part")
def regex_classify(spark, sf):
    return read(spark, sf, "part").select("p_partkey", scalars.keyword_class(F.col("p_type"), [("STEEL|BRASS", "metal"), ("tin", "tin")], "other").alias("kind"), scalars.keyword_classes(F.col("p_name"), [("A", "has-a"), ("[0-9]+", "number")]).alias("tags"))


@query("SELECT p_partkey, p_size / 100 AS learning_rate, p_size::BIGINT AS epochs, (p_size * 2)::BIGINT AS batch_size, p_brand AS backbone, NULL::VARCHAR AS neck FROM part")
def plan_decode(spark, sf):
    part = read(spark, sf, "part")
    plan = F.concat(F.lit("lr"), (F.col("p_size") / 100).cast("string"), F.lit("epochs"), "p_size", F.lit("bsize"), F.col("p_size") * 2)
    names = scalars.name_parts(F.concat(F.lit("m_"), F.col("p_brand")), ["model", "backbone", "neck"])
    return part.select("p_partkey", *[c.alias(n) for n, c in scalars.plan_fields(plan).items()], names["backbone"].alias("backbone"), names["neck"].alias("neck"))


@query("SELECT 'orders' AS version, count(*) AS items, max(o_totalprice) AS top, NULL::BIGINT AS classes FROM orders UNION ALL SELECT 'embeddings', count(*), NULL, count(DISTINCT label) FROM embeddings")
def comparison_table(spark, sf):
    a = read(spark, sf, "orders").agg(F.lit("orders").alias("version"), F.count("*").alias("items"), F.max("o_totalprice").alias("top"))
    b = read(spark, sf, "embeddings").agg(F.lit("embeddings").alias("version"), F.count("*").alias("items"), F.count_distinct("label").alias("classes"))
    return profiles.comparison([a, b])


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def metadata_join(spark, sf):
    return profiles.described(read(spark, sf, "nation").withColumnRenamed("n_regionkey", "metadata_id"), read(spark, sf, "region").withColumnRenamed("r_regionkey", "metadata_id")).select("n_name", "r_name")


@query("SELECT arg_max(doc_id, doc_id) AS doc_id, lang FROM documents GROUP BY lang")
def last_match_by_name(spark, sf):
    return first_per_key(read(spark, sf, "documents").select("lang", "doc_id"), ["lang"], ["-doc_id"]).select("doc_id", "lang")


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DECIMAL(20, 2)::DOUBLE AS total FROM (SELECT user_id, event_id, ts, value::DECIMAL(18, 2) AS value FROM events)")
def training_log_totals(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    return running_totals(rows, ["user_id"], ["ts", "event_id"], {"total": F.col("value")}).select("user_id", "event_id", F.col("total").cast("double").alias("total"))


@query()
def sample_rows(spark, sf):
    from ..operators.traverse import sampled_rows

    return sampled_rows(read(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], 20, 3)


@query()
def sample_with_replacement(spark, sf):
    from ..operators.traverse import drawn_rows

    return drawn_rows(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 50, 3)


def history(spark, sf) -> lineage.Lineage:
    """Data versions are nations, models suppliers' remainders, trainings suppliers;
    inferences are made from them. All are numbered from 0 or 1, so kinds share ids."""
    s = read(spark, sf, "supplier")
    none = F.create_map().cast("map<string,string>")
    node = lambda label, name: s.select(F.lit(label).alias("label"), name.alias("id")).distinct().withColumn("props", none)
    d, m, t = (c.cast("string") for c in (F.col("s_nationkey"), F.col("s_suppkey") % 9, F.col("s_suppkey")))
    out = lineage.Lineage.empty(spark)
    out = out.merge_nodes(node(lineage.DATA, d).unionAll(node(lineage.MODEL, m)).unionAll(node(lineage.TRAINING, t)).unionAll(node(lineage.INFERENCE, t)))
    out = out.create_edges("DATA_TRAINING", lineage.DATA, lineage.TRAINING, s.select(d.alias("src"), t.alias("dst"))).create_edges("MODEL_TRAINING", lineage.MODEL, lineage.TRAINING, s.select(m.alias("src"), t.alias("dst")))
    return out.create_edges("DEPLOY", lineage.TRAINING, lineage.INFERENCE, s.filter("s_suppkey % 2 = 0").select(t.alias("src"), t.alias("dst")), {"optimization": "none"})


@query("SELECT s_nationkey::VARCHAR AS \"at\", s_suppkey::VARCHAR AS next FROM supplier")
def lineage_1hop(spark, sf):
    h = history(spark, sf)
    return h.step(h.start(lineage.DATA), "DATA_TRAINING").select("at", "next")


@query("SELECT s_nationkey::VARCHAR AS data, s_suppkey::VARCHAR AS training, s_suppkey::VARCHAR AS inference FROM supplier WHERE s_suppkey % 2 = 0")
def lineage_2hop(spark, sf):
    h = history(spark, sf)
    return h.path(h.start(lineage.DATA).withColumn("data", F.col("at")), [("training", "DATA_TRAINING", False), ("inference", "DEPLOY", False)])


@query("SELECT s_suppkey::VARCHAR AS inference, s_suppkey::VARCHAR AS training, (s_suppkey % 9)::VARCHAR AS model, s_nationkey::VARCHAR AS data FROM supplier WHERE s_suppkey % 2 = 0")
def lineage_pipeline(spark, sf):
    h = history(spark, sf)
    return h.pipelines(h.start(lineage.INFERENCE))


@query("SELECT label, count(*) AS n FROM (SELECT DISTINCT 'Data_Version' AS label, s_nationkey AS k FROM supplier UNION SELECT 'Model_Version', s_suppkey % 9 FROM supplier UNION SELECT 'Training_Version', s_suppkey FROM supplier UNION SELECT 'Inference_Version', s_suppkey FROM supplier) GROUP BY label")
def lineage_merge_nodes(spark, sf):
    h = history(spark, sf)
    return h.merge_nodes(h.nodes).nodes.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey = 5 THEN '12' END AS epochs FROM supplier")
def lineage_set_properties(spark, sf):
    h = history(spark, sf).set_props((F.col("label") == lineage.TRAINING) & (F.col("id") == "5"), {"epochs": "12"})
    return h.select(lineage.TRAINING).select("id", F.col("props")["epochs"].alias("epochs"))


@query("SELECT type, src_label, dst_label, count(*) AS n FROM (SELECT 'DATA_TRAINING' AS type, 'Data_Version' AS src_label, 'Training_Version' AS dst_label FROM supplier UNION ALL SELECT 'MODEL_TRAINING', 'Model_Version', 'Training_Version' FROM supplier UNION ALL SELECT 'DEPLOY', 'Training_Version', 'Inference_Version' FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY ALL")
def lineage_shared_ids(spark, sf):
    return history(spark, sf).edges.groupBy("type", "src_label", "dst_label").agg(F.count("*").alias("n"))


@query("SELECT 'DATA_TRAINING' AS type, count(*) AS n FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 'MODEL_TRAINING', count(*) FROM supplier UNION ALL SELECT 'DEPLOY', count(*) FROM supplier WHERE s_suppkey % 2 = 0")
def lineage_detach_delete(spark, sf):
    h = history(spark, sf)
    gone = h.nodes.filter((F.col("label") == lineage.DATA) & (F.col("id") == "3"))
    return h.detach(gone).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT src_label, src, dst, count(*) AS n FROM (SELECT 'Data_Version' AS src_label, s_nationkey::VARCHAR AS src, s_suppkey::VARCHAR AS dst FROM supplier) GROUP BY ALL")
def lineage_merged_edges(spark, sf):
    h = history(spark, sf)
    pairs = read(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("src"), F.col("s_suppkey").cast("string").alias("dst"))
    twice = h.create_edges("HAS_IMAGE", lineage.DATA, lineage.TRAINING, pairs.unionAll(pairs), once=True).create_edges("HAS_IMAGE", lineage.DATA, lineage.TRAINING, pairs, once=True)
    return twice.edges.filter("type = 'HAS_IMAGE'").groupBy("src_label", "src", "dst").agg(F.count("*").alias("n"))


@query("SELECT k::VARCHAR AS id, k IN (SELECT s_suppkey FROM supplier) AS there FROM (VALUES (1), (2), (900000000)) t(k)")
def lineage_exists(spark, sf):
    h = history(spark, sf)
    wanted = spark.createDataFrame([("1",), ("2",), ("900000000",)], "id string")
    own = h.select(lineage.TRAINING).select("id", F.lit(True).alias("own"))
    return wanted.join(own, "id", "left").select("id", F.coalesce("own", F.lit(False)).alias("there"))


@query("SELECT * FROM (VALUES ('3', '1'), ('3', '2')) t(\"at\", next)")
def lineage_parents(spark, sf):
    return family(spark).parents(spark.createDataFrame([("3",)], "at string")).select("at", "next")


def family(spark) -> lineage.Lineage:
    """Data versions 1 to 5 and trainings 1 to 3: 3 is merged from 1 and 2, 4 filtered from
    3 and merged from 1, training 3 transferred from 1 and 2."""
    nodes = [(lineage.DATA, str(k), {}) for k in range(1, 6)] + [(lineage.TRAINING, str(k), {}) for k in range(1, 4)]
    h = lineage.Lineage(spark.createDataFrame(nodes, lineage.NODES), spark.createDataFrame([], lineage.EDGES))
    pairs = lambda *of: spark.createDataFrame(list(of), "src string, dst string")
    h = h.create_edges("MERGE_DATA", lineage.DATA, lineage.DATA, pairs(("1", "3"), ("2", "3"), ("9", "3"), ("1", "4"))).create_edges("FILTER_DATA", lineage.DATA, lineage.DATA, pairs(("3", "4")), {"filter_conditions": "labels"})
    return h.create_edges("TRAINING_TRANSFER", lineage.TRAINING, lineage.TRAINING, pairs(("1", "3"), ("2", "3"), ("5", "3")))


@query("SELECT * FROM (VALUES ('3', '1', 'MERGE_DATA'), ('3', '2', 'MERGE_DATA'), ('4', '3', 'FILTER_DATA')) t(\"at\", next, edge_name)")
def lineage_parents_many(spark, sf):
    return family(spark).parents(spark.createDataFrame([("3",), ("4",), ("5",)], "at string"))


@query("SELECT * FROM (VALUES ('T3', '1', 'TRAINING_TRANSFER'), ('T3', '2', 'TRAINING_TRANSFER')) t(\"at\", next, edge_name)")
def transfer_parents(spark, sf):
    return family(spark).transfer_parents(spark.createDataFrame([("T3",), ("1",)], "at string"))


@query("SELECT k AS inference, [d, 'M' || m, 'T' || k, 'I' || k] AS indices, ['Dataset: ' || d, 'Model: M' || m, 'Training: T' || k, 'Inference: I' || k] AS labels, ['dataset', 'model', 'training', 'inference'] AS classes, [[d, 'T' || k], ['M' || m, 'T' || k], ['T' || k, 'I' || k]] AS edges, ['DATA_TRAINING', 'MODEL_TRAINING', 'DEPLOY'] AS eprobs FROM (SELECT s_suppkey::VARCHAR AS k, (s_suppkey % 9)::VARCHAR AS m, s_nationkey::VARCHAR AS d FROM supplier WHERE s_suppkey % 2 = 0)")
def pipeline_graph(spark, sf):
    h = history(spark, sf)
    return h.pipeline_graphs(h.start(lineage.INFERENCE))


@query("SELECT * FROM (VALUES ('3', ['1', '2'], ['Dataset: 1', 'Dataset: 2'], ['dataset', 'dataset'], [['1', '3'], ['2', '3']], ['MERGE_DATA', 'MERGE_DATA']), ('4', ['3'], ['Dataset: 3'], ['dataset'], [['3', '4']], ['FILTER_DATA'])) t(\"at\", indices, labels, classes, edges, eprobs)")
def pipeline_graph_of_data(spark, sf):
    h = family(spark)
    return h.parent_graphs(h.parents(spark.createDataFrame([("3",), ("4",), ("5",)], "at string")))


@query("WITH j AS (SELECT p_partkey, p_brand, p_type, p_size FROM part) SELECT * FROM j WHERE p_brand = 'Brand#11' UNION ALL SELECT * FROM j WHERE p_size = 5 UNION ALL SELECT * FROM j WHERE p_type = (SELECT min(p_type) FROM part)")
def lineage_star_union(spark, sf):
    part = read(spark, sf, "part")
    least = part.agg(F.min("p_type")).first()[0]
    dims = {c: (part.select("p_partkey", c), cond) for c, cond in (("p_brand", F.col("p_brand") == "Brand#11"), ("p_type", F.col("p_type") == least), ("p_size", F.col("p_size") == 5))}
    return lineage.star_union(part.select("p_partkey"), dims, "p_partkey").select("p_partkey", "p_brand", "p_type", "p_size")


@query("SELECT 't' || s_suppkey AS training, 'd' || s_nationkey AS data, s_suppkey % 9 AS model, s_suppkey AS inference FROM supplier WHERE s_suppkey % 9 = 4 AND s_suppkey % 2 = 0")
def pipeline_search(spark, sf):
    s = read(spark, sf, "supplier")
    data = s.select(F.concat(F.lit("d"), "s_nationkey").alias("data")).distinct()
    trainings = s.select(F.concat(F.lit("t"), "s_suppkey").alias("training"), F.concat(F.lit("d"), "s_nationkey").alias("data"), (F.col("s_suppkey") % 9).alias("model"))
    deployed = s.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("t"), "s_suppkey").alias("training"), F.col("s_suppkey").alias("inference"))
    return lineage.pipeline_search(data, trainings, deployed, model=4, device=None)


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def conversation_turns(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
