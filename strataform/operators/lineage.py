"""Lineage: versions of data, models, trainings and predictions as nodes and typed edges.

nodes (label, id, props map<string,string>); edges (type, src_label, src, dst_label, dst,
props). Versions of different kinds share their numbers, so a node is always told by its
label and id."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "label string, id string, props map<string,string>"
EDGES = "type string, src_label string, src string, dst_label string, dst string, props map<string,string>"
ENDS = ["src_label", "src", "dst_label", "dst"]
DATA, MODEL, TRAINING, INFERENCE = "Data_Version", "Model_Version", "Training_Version", "Inference_Version"


@dataclass(frozen=True)
class Lineage:
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Lineage:
        return Lineage(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    def merge_nodes(self, new: DataFrame) -> Lineage:
        """Add nodes unless one with the same label, id and properties is there."""
        mark = lambda df: df.withColumn("_p", F.to_json(F.array_sort(F.map_entries("props"))))
        rows = mark(new).dropDuplicates(["label", "id", "_p"]).join(mark(self.nodes).select("label", "id", "_p"), ["label", "id", "_p"], "left_anti")
        return replace(self, nodes=self.nodes.unionByName(rows.select("label", "id", "props")))

    def create_edges(self, kind: str, src_label: str, dst_label: str, pairs: DataFrame, props: dict[str, str] | None = None, once: bool = False) -> Lineage:
        """An edge for each pair (src, dst) of nodes with those labels that exist, one for
        each matching pair of nodes; once: not those that there are."""
        end = lambda label, name: self.nodes.filter(F.col("label") == label).select(F.col("id").alias(name))
        rows = pairs.select("src", "dst").join(end(src_label, "src"), "src").join(end(dst_label, "dst"), "dst")
        made = F.create_map(*[F.lit(x) for kv in (props or {}).items() for x in kv]).cast("map<string,string>")
        rows = rows.select(F.lit(kind).alias("type"), F.lit(src_label).alias("src_label"), "src", F.lit(dst_label).alias("dst_label"), "dst", made.alias("props"))
        if once:
            rows = rows.dropDuplicates(ENDS).join(self.edges.filter(F.col("type") == kind).select(*ENDS), ENDS, "left_anti")
        return replace(self, edges=self.edges.unionByName(rows.select("type", *ENDS, "props")))

    def set_props(self, condition: Column, values: dict[str, str]) -> Lineage:
        new = F.map_concat(F.map_filter("props", lambda k, _: ~k.isin(list(values))), F.create_map(*[F.lit(x) for kv in values.items() for x in kv]))
        return replace(self, nodes=self.nodes.withColumn("props", F.when(condition, new).otherwise(F.col("props"))))

    def select(self, label: str, **props: str) -> DataFrame:
        rows = self.nodes.filter(F.col("label") == label)
        for k, v in props.items():
            rows = rows.filter(F.col("props")[k] == v)
        return rows

    def exists(self, label: str, **props: str) -> bool:
        return not self.select(label, **props).limit(1).isEmpty()

    def start(self, label: str, ids: DataFrame | None = None) -> DataFrame:
        """(at_label, at): the nodes of a label, or ids (at) as such."""
        rows = self.nodes.filter(F.col("label") == label).select(F.col("id").alias("at")) if ids is None else ids
        return rows.withColumn("at_label", F.lit(label))

    def step(self, start: DataFrame, kind: str, reverse: bool = False) -> DataFrame:
        """start with (next_label, next): a row for each edge of the kind from (at_label, at)."""
        a, b = ("dst", "src") if reverse else ("src", "dst")
        own = self.edges.filter(F.col("type") == kind)
        own = own.select(F.col(f"{a}_label").alias("at_label"), F.col(a).alias("at"), F.col(f"{b}_label").alias("next_label"), F.col(b).alias("next"))
        return start.join(own, ["at_label", "at"])

    def path(self, start: DataFrame, hops: list[tuple[str, str, bool]]) -> DataFrame:
        """Follow hops (name, edge type, reversed) from start (at_label, at): a column for each hop."""
        rows = start
        for name, kind, reverse in hops:
            rows = self.step(rows, kind, reverse).drop("at_label", "at").withColumn(name, F.col("next")).withColumnsRenamed({"next_label": "at_label", "next": "at"})
        return rows.drop("at_label", "at")

    def pipelines(self, inferences: DataFrame) -> DataFrame:
        """(inference, training, model, data) for each inference (at): each model with each
        data version of its training."""
        first = self.start(INFERENCE, inferences.select("at", F.col("at").alias("inference")))
        trained = self.path(first, [("training", "DEPLOY", True)]).withColumns({"at_label": F.lit(TRAINING), "at": F.col("training")})
        models = self.path(trained, [("model", "MODEL_TRAINING", True)]).withColumns({"at_label": F.lit(TRAINING), "at": F.col("training")})
        return self.path(models, [("data", "DATA_TRAINING", True)]).select("inference", "training", "model", "data")

    def parents(self, versions: DataFrame) -> DataFrame:
        """(at, next, edge_name): the parents of data versions (at) by filtering; for each
        version without such, those by merging."""
        rows = self.start(DATA, versions)
        filtered = self.step(rows, "FILTER_DATA", True)
        rest = rows.join(filtered.select("at"), "at", "left_anti")
        named = lambda found, kind: found.select("at", "next", F.lit(kind).alias("edge_name"))
        return named(filtered, "FILTER_DATA").unionAll(named(self.step(rest, "MERGE_DATA", True), "MERGE_DATA"))

    def transfer_parents(self, trainings: DataFrame) -> DataFrame:
        """(at, next, edge_name): the trainings that trainings (at) were transferred from. An
        id with a T in it is written with a letter in front, which is not part of the id."""
        rows = trainings.withColumn("given", F.col("at")).withColumn("at", F.when(F.contains("at", F.lit("T")), F.expr("substring(at, 2)")).otherwise(F.col("at")))
        found = self.step(self.start(TRAINING, rows), "TRAINING_TRANSFER", True)
        return found.select(F.col("given").alias("at"), "next", F.lit("TRAINING_TRANSFER").alias("edge_name"))

    def pipeline_graphs(self, inferences: DataFrame) -> DataFrame:
        """(inference, indices, labels, classes, edges, eprobs) for each pipeline of inferences (at)."""
        rows = self.pipelines(inferences)
        names = [("data", "Dataset"), ("model", "Model"), ("training", "Training"), ("inference", "Inference")]
        short = {c: F.col(c) if c == "data" else F.concat(F.lit(c[0].upper()), c) for c, _ in names}
        edge = lambda a, b: F.array(short[a], short[b])
        return rows.select(
            "inference", F.array(*short.values()).alias("indices"), F.array(*[F.concat(F.lit(f"{title}: "), short[c]) for c, title in names]).alias("labels"),
            F.array(*[F.lit(title.lower()) for _, title in names]).alias("classes"), F.array(edge("data", "training"), edge("model", "training"), edge("training", "inference")).alias("edges"),
            F.array(F.lit("DATA_TRAINING"), F.lit("MODEL_TRAINING"), F.lit("DEPLOY")).alias("eprobs"),
        )

    def parent_graphs(self, versions: DataFrame, title: str = "Dataset") -> DataFrame:
        """The same columns by version, from rows (at, next, edge_name) of parents or
        transfer_parents: a version's parents are few."""
        each = versions.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("next", "edge_name"))).alias("up"))
        of = lambda f: F.transform("up", f)
        return each.select(
            "at", of(lambda u: u["next"]).alias("indices"), of(lambda u: F.concat(F.lit(f"{title}: "), u["next"])).alias("labels"), of(lambda u: F.lit(title.lower())).alias("classes"),
            of(lambda u: F.array(u["next"], F.col("at"))).alias("edges"), of(lambda u: u["edge_name"]).alias("eprobs"),
        )

    def detach(self, gone: DataFrame) -> Lineage:
        """Without the nodes gone (label, id) and their edges."""
        keys = lambda side: gone.select(F.col("label").alias(f"{side}_label"), F.col("id").alias(side))
        edges = self.edges.join(keys("src"), ["src_label", "src"], "left_anti").join(keys("dst"), ["dst_label", "dst"], "left_anti")
        return Lineage(self.nodes.join(gone.select("label", "id"), ["label", "id"], "left_anti").select("label", "id", "props"), edges.select("type", *ENDS, "props"))


def star_union(models: DataFrame, dimensions: dict[str, tuple[DataFrame, Column]], key: str) -> DataFrame:
    """Models joined with all dimensions, once for each dimension's condition, results one
    below the other with repeats."""
    joined = models
    for rows, _ in dimensions.values():
        joined = joined.join(rows, key)
    out = None
    for _, condition in dimensions.values():
        part = joined.filter(condition)
        out = part if out is None else out.unionAll(part)
    return out


def pipeline_search(data: DataFrame, trainings: DataFrame, inferences: DataFrame, **equal) -> DataFrame:
    """(data, training, model, inference) chains; equal gives optional field = value."""
    rows = data.join(trainings, "data").join(inferences, "training")
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows
