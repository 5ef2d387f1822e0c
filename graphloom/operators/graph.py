"""The graph model and its construction steps: fusing, filtering, writing (F, W, 1.1).

A graph is two DataFrames, ``nodes(id, name, label, properties)`` and
``edges(id, from_id, from_type, to_id, to_type, label, properties)``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import canonical_map, namespaced, reference_list
from graphloom.session import cut

NODE_SCHEMA = "id string, name string, label string, properties map<string,string>"
EDGE_SCHEMA = "id string, from_id string, from_type string, to_id string, to_type string, label string, properties map<string,string>"
NODE_COLUMNS = ["id", "name", "label", "properties"]
EDGE_COLUMNS = ["id", "from_id", "from_type", "to_id", "to_type", "label", "properties"]
ENDS = ["from_id", "from_type", "to_id", "to_type", "label"]


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def node_key(i: Column, name: Column, label: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(i, F.lit("")), F.coalesce(name, F.lit("")), F.coalesce(label, F.lit(""))), 256)


def edge_id(properties: Column) -> Column:
    """A content hash of the six other fields: edges have stable ids."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in ENDS], canonical_map(properties)), 256)


def as_nodes(df: DataFrame, i: Column, label: str | Column, name: Column | None = None, properties: Column | None = None) -> DataFrame:
    """A missing name is the id."""
    label = F.lit(label) if isinstance(label, str) else label
    i = i.cast("string")
    return df.select(i.alias("id"), F.coalesce(name.cast("string") if name is not None else i, i).alias("name"), label.alias("label"), (properties if properties is not None else empty_map()).alias("properties"))


def as_edges(df: DataFrame, source: Column, source_type: str | Column, label: str | Column, target: Column, target_type: str | Column, properties: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    edges = df.select(
        source.cast("string").alias("from_id"), lit(source_type).alias("from_type"), target.cast("string").alias("to_id"), lit(target_type).alias("to_type"),
        lit(label).alias("label"), (properties if properties is not None else empty_map()).alias("properties"),
    )
    return edges.withColumn("id", edge_id(F.col("properties"))).select(*EDGE_COLUMNS)


def properties_of(*columns: str, **renamed: Column) -> Column:
    """A string map of columns; null values are left out."""
    pairs = {c: F.col(c) for c in columns} | renamed
    made = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(made, lambda _, v: v.isNotNull())


@dataclass
class Graph:
    """Nodes and edges with the store operations of W1-W6 and Q1-Q4, Q17."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

    def plus(self, other: Graph) -> Graph:
        """concatenation, nothing merged."""
        return Graph(self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges))

    def aligned(self) -> Graph:
        """value-equal nodes (ids aside) and edges once."""
        nodes = self.nodes.withColumn("_p", canonical_map(F.col("properties"))).groupBy("name", "label", "_p").agg(F.min_by(F.struct("id", "properties"), "id").alias("x"))
        return Graph(nodes.select("x.id", "name", "label", "x.properties"), distinct_edges(self.edges))

    def upsert(self, other: Graph) -> Graph:
        """Nodes by (label, id), new values win per key; edges by their ends and label."""
        both = self.nodes.withColumn("seq", F.lit(0)).unionByName(other.nodes.withColumn("seq", F.lit(1)))
        edges = self.edges.withColumn("seq", F.lit(0)).unionByName(other.edges.withColumn("seq", F.lit(1)))
        return Graph(merge_nodes(both, last=True), merge_edges(edges))

    def without(self, ids: DataFrame) -> Graph:
        """``ids(label, id)`` and every edge at them."""
        nodes = self.nodes.join(ids.select("label", "id"), ["label", "id"], "left_anti").select(*NODE_COLUMNS)
        edges = self.edges
        for end in ("from", "to"):
            gone = ids.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_type"))
            edges = edges.join(gone, [f"{end}_id", f"{end}_type"], "left_anti")
        return Graph(nodes, edges.select(*EDGE_COLUMNS))

    def closed(self) -> Graph:
        """Edges whose two ends exist."""
        edges = self.edges
        for end in ("from", "to"):
            there = self.nodes.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_type"))
            edges = edges.join(there, [f"{end}_id", f"{end}_type"], "left_semi")
        return Graph(self.nodes, edges.select(*EDGE_COLUMNS))

    def entity(self, identifier: str, label: str) -> DataFrame:
        """Q1."""
        return self.nodes.where((F.col("id") == identifier) & (F.col("label") == label))

    def entities(self, labels: list[str], ids: DataFrame) -> DataFrame:
        """Q2: nodes of some labels with an id of ``ids(id)``."""
        return self.nodes.where(F.col("label").isin(labels)).join(ids.select("id"), "id", "left_semi")

    def one_hop(self, starts: DataFrame, types: list[str] | None = None) -> DataFrame:
        """Q3, Q4: (s_id, s_type, direction, rel, o_id, o_type, o_name) around ``starts(id, label)``."""
        edges = self.edges.where(F.col("label").isin(types)) if types else self.edges
        sides = []
        for near, far, direction in (("from", "to", "out"), ("to", "from", "in")):
            hits = edges.join(starts.select(F.col("id").alias(f"{near}_id"), F.col("label").alias(f"{near}_type")).distinct(), [f"{near}_id", f"{near}_type"])
            sides.append(hits.select(F.col(f"{near}_id").alias("s_id"), F.col(f"{near}_type").alias("s_type"), F.lit(direction).alias("direction"), F.col("label").alias("rel"), F.col(f"{far}_id").alias("o_id"), F.col(f"{far}_type").alias("o_type")))
        names = self.nodes.select(F.col("id").alias("o_id"), F.col("label").alias("o_type"), F.col("name").alias("o_name"))
        return sides[0].unionByName(sides[1]).join(names, ["o_id", "o_type"], "left")

    def attributes(self) -> DataFrame:
        """Each property as a relation to a pseudo entity."""
        return self.nodes.select(F.col("id").alias("s_id"), F.col("label").alias("s_type"), F.explode("properties").alias("rel", "o_name")).withColumn("o_type", F.lit("attribute"))

    def counts(self) -> DataFrame:
        """Q17."""
        return self.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def written(self, path: str) -> None:
        """Partitioned by label, so label filters prune files."""
        self.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Graph:
        """S16."""
        return cls(spark.read.parquet(f"{path}/nodes").select(*NODE_COLUMNS), spark.read.parquet(f"{path}/edges").select(*EDGE_COLUMNS))


def distinct_edges(edges: DataFrame) -> DataFrame:
    rows = edges.withColumn("_p", canonical_map(F.col("properties")))
    picked = rows.groupBy(*ENDS, "_p").agg(F.min_by(F.struct("id", "properties"), "id").alias("x"))
    return picked.select("x.id", *ENDS, "x.properties").select(*EDGE_COLUMNS)


def _merged(rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """(keys, properties): one value a key of the maps, of the last or first row by seq.

    Entries are aggregated, never whole groups, so a key held by very many rows is
    combined before the shuffle.
    """
    pick = F.max_by if last else F.min_by
    entries = rows.select(*keys, "seq", F.explode_outer("properties").alias("k", "v"))
    values = entries.groupBy(*keys, "k").agg(pick(F.col("v"), F.struct("seq", "v")).alias("v"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))
    return values.groupBy(*keys).agg(F.map_from_entries(pairs).alias("properties"))


def merge_nodes(nodes: DataFrame, last: bool) -> DataFrame:
    """F3 (first wins), W3 and X7a (last wins): one node per (label, id); ``seq`` is the order."""
    pick = F.max_by if last else F.min_by
    names = nodes.groupBy("label", "id").agg(pick("name", F.struct("seq", "name")).alias("name"))
    return names.join(_merged(nodes, ["label", "id"], last), ["label", "id"]).select(*NODE_COLUMNS)


def merge_edges(edges: DataFrame) -> DataFrame:
    merged = _merged(edges, ENDS, last=True)
    return merged.withColumn("id", edge_id(F.col("properties"))).select(*EDGE_COLUMNS)


def merge_records(records: DataFrame, multi: list[str]) -> DataFrame:
    """per type and name, multi-valued properties are united (sorted), others take the last value.

    ``records(type, name, seq, properties)``.
    """
    entries = records.select("type", "name", "seq", F.explode("properties").alias("k", "v"))
    many = entries.where(F.col("k").isin(multi)).select("type", "name", "k", F.explode(reference_list(F.col("v"))).alias("part")).groupBy("type", "name", "k").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("v"))
    one = entries.where(~F.col("k").isin(multi)).groupBy("type", "name", "k").agg(F.max_by("v", F.struct("seq", "v")).alias("v"))
    rows = many.unionByName(one).groupBy("type", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return rows


def valid(graph: Graph, labels: list[str], namespace: str | None = None) -> Graph:
    """incomplete nodes and edges go, unknown labels become Others."""
    there = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    known = F.col("label").isin(labels)
    others = f"{namespace}.Others" if namespace else "Others"
    nodes = graph.nodes.where(there("id") & there("label"))
    if namespace:
        nodes = nodes.withColumn("label", namespaced(F.col("label"), namespace))
        known = F.split_part(F.col("label"), F.lit("."), F.lit(2)).isin(labels)
    return Graph(nodes.withColumn("label", F.when(known, F.col("label")).otherwise(others)), graph.edges.where(there("label") & there("from_id") & there("to_id")))


def subgraph_key(members: DataFrame) -> DataFrame:
    """(graph_key, hash) of ``members(graph_key, member_hash)``."""
    return members.groupBy("graph_key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("member_hash")), ""), 256).alias("hash"))


# statistics


def type_counts(graph: Graph) -> DataFrame:
    nodes = graph.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    return nodes.unionByName(graph.edges.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge")))


def degrees(graph: Graph) -> DataFrame:
    """(id, label, degree), nodes without edges included."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.col("from_type").alias("label")), F.struct(F.col("to_id").alias("id"), F.col("to_type").alias("label")))).alias("x"))
    counted = ends.groupBy("x.id", "x.label").agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("id", "label").join(counted, ["id", "label"], "left").fillna(0, ["degree"])


def top_degree(graph: Graph, n: int = 3) -> DataFrame:
    return degrees(graph).orderBy(F.desc("degree"), "label", "id").limit(n)


def degree_summary(graph: Graph) -> DataFrame:
    return degrees(graph).agg(F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))


def external_graph(spark: SparkSession, nodes: str, edges: str) -> Graph:
    """A graph from files of JSON lines; missing properties are empty, missing names are ids, ids of edges are made anew."""
    n = spark.read.schema(NODE_SCHEMA).json(nodes).where("id IS NOT NULL AND label IS NOT NULL")
    e = spark.read.schema(EDGE_SCHEMA).json(edges).where("from_id IS NOT NULL AND to_id IS NOT NULL AND label IS NOT NULL")
    properties = F.coalesce("properties", empty_map())
    return Graph(as_nodes(n, F.col("id"), F.col("label"), F.col("name"), properties), as_edges(e, F.col("from_id"), F.col("from_type"), F.col("label"), F.col("to_id"), F.col("to_type"), properties))


def label_batches(nodes: DataFrame, size: int = 4096) -> DataFrame:
    """Number of the batch that a node is dumped in, by label, in the order of ids.

    Ranges of labels and ids are counted, and nodes numbered within their range, so no
    task holds a label.
    """
    ranged = cut(nodes.repartitionByRange(F.col("label"), F.col("id")).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("label", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("label", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("label", "_range").orderBy("id")
    numbered = ranged.join(before, ["label", "_range"]).withColumn("batch", F.floor((F.col("_before") + F.row_number().over(within) - 1) / size).cast("long"))
    return numbered.select(*nodes.columns, "batch")


# bindings (G7-G9)


def merge_bindings(frames: list[DataFrame]) -> DataFrame:
    """Entities (alias, biz_id, name, type, description) by biz_id; later non-empty values win."""
    rows = reduce(DataFrame.unionByName, [f.withColumn("seq", F.lit(i)) for i, f in enumerate(frames)])
    full = lambda c: F.max_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq"))).alias(c)
    return rows.groupBy("alias", "biz_id").agg(full("name"), full("type"), full("description"))


def intersect_bindings(earlier: DataFrame, later: DataFrame, on: list[str]) -> DataFrame:
    """Earlier rows whose shared end was bound again."""
    return earlier.join(later.select(*on).distinct(), on, "left_semi")
