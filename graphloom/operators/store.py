"""A stored graph that takes merges (W1, W3, W5, W6, S16) without being rewritten.

Nodes and edges are written as versions, each partitioned by label.  An upsert writes
only what it brings; a deletion writes only keys.  The manifest tells for each label
which versions hold its rows and, in order, which deletions came between.  Reading a
label merges its versions, the last value of a property or, on request, the first node;
a label that has gathered ``fan_in`` versions is rewritten as one, other labels stay.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from graphloom.functions.text import namespaced
from graphloom.operators.graph import EDGE_COLUMNS, EDGE_SCHEMA, ENDS, NODE_COLUMNS, NODE_SCHEMA, Graph, edge_id, merge_edges, merge_nodes
from graphloom.sources.manifest import Manifest

KINDS = {"nodes": (NODE_SCHEMA, NODE_COLUMNS), "edges": (EDGE_SCHEMA, EDGE_COLUMNS)}


def encoded(rows: DataFrame) -> DataFrame:
    """``properties`` as a map of strings: a struct's fields or a map's values; what is no string is written as JSON, nulls go."""
    kind = rows.schema["properties"].dataType
    if isinstance(kind, MapType) and isinstance(kind.valueType, StringType):
        return rows
    text = lambda v, t: v if isinstance(t, StringType) else F.to_json(v) if t.typeName() in ("array", "map", "struct") else v.cast("string")
    if isinstance(kind, MapType):
        made = F.transform_values("properties", lambda _, v: text(v, kind.valueType))
    else:
        made = F.create_map(*[x for f in kind.fields for x in (F.lit(f.name), text(F.col("properties").getField(f.name), f.dataType))])
    return rows.withColumn("properties", F.map_filter(made, lambda _, v: v.isNotNull()).cast("map<string,string>"))


class GraphStore:
    """A graph at ``path``; with a namespace, labels are written as ``namespace.label`` and read without it."""

    def __init__(self, spark: SparkSession, path: str, namespace: str | None = None, fan_in: int = 4):
        self.spark, self.path, self.namespace, self.fan_in = spark, path, namespace, fan_in
        self.manifest = Manifest(spark, path)

    def _state(self) -> tuple[int, dict]:
        version = self.manifest.version()
        return version, self.manifest.read(version) or {"next": 0, "nodes": {}, "edges": {}, "gone": []}

    def _label(self, column: Column) -> Column:
        return namespaced(column, self.namespace) if self.namespace else column

    def upsert(self, graph: Graph) -> None:
        """Nodes by label and id, edges by their ends and label; new values win, key by key."""
        version, state = self._state()
        nodes = encoded(graph.nodes).withColumn("label", self._label(F.col("label")))
        edges = encoded(graph.edges)
        for column in ("from_type", "to_type"):
            edges = edges.withColumn(column, self._label(F.col(column)))
        number = state["next"]
        for kind, rows in (("nodes", merge_nodes(nodes.withColumn("seq", F.lit(0)), last=True)), ("edges", merge_edges(edges.withColumn("seq", F.lit(0))))):
            self._put(kind, rows, number, state)
        state["next"] = number + 1
        full = [(k, label) for k in KINDS for label, held in state[k].items() if len(held) >= self.fan_in]
        self._compacted(full, state)
        self.manifest.write(state, version)

    def _put(self, kind: str, rows: DataFrame, number: int, state: dict) -> None:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.partitionBy("label").parquet(f"{self.path}/{name}")
        # the labels are those of the folders
        for r in self._version(kind, name).select("label").distinct().collect():
            state[kind].setdefault(r.label, []).append([number, name])

    def delete(self, keys: DataFrame) -> None:
        """Nodes of ``keys(id, label)`` and every edge at them."""
        version, state = self._state()
        name = f"gone-{uuid.uuid4().hex}"
        keys.select("id", self._label(F.col("label")).alias("label")).distinct().write.parquet(f"{self.path}/{name}")
        state["gone"].append([state["next"], name])
        state["next"] += 1
        self.manifest.write(state, version)

    def compact(self) -> None:
        """All labels as one version each; deletions that no version precedes are forgotten."""
        version, state = self._state()
        self._compacted([(k, label) for k in KINDS for label in state[k]], state)
        self.manifest.write(state, version)

    def _compacted(self, labels: list[tuple[str, str]], state: dict) -> None:
        if not labels:
            return
        number = state["next"]
        for kind in KINDS:
            own = [label for k, label in labels if k == kind]
            if own:
                rows = self._rows(kind, state, own, first=False)
                for label in own:
                    state[kind][label] = []
                self._put(kind, rows, number, state)
                state[kind] = {label: held for label, held in state[kind].items() if held}
        state["next"] = number + 1
        oldest = min((held[0][0] for k in KINDS for held in state[k].values()), default=number)
        state["gone"] = [g for g in state["gone"] if g[0] > oldest]

    def _version(self, kind: str, name: str) -> DataFrame:
        schema, columns = KINDS[kind]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*columns)

    def _rows(self, kind: str, state: dict, labels: list[str] | None, first: bool) -> DataFrame:
        """Merged rows of some labels; labels of one version are only filtered."""
        schema, columns = KINDS[kind]
        chosen = {label: held for label, held in state[kind].items() if labels is None or label in labels}
        parts: dict[tuple[int, str], list[str]] = {}
        for label, held in chosen.items():
            for number, name in held:
                parts.setdefault((number, name), []).append(label)
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, [self._version(kind, name).where(F.col("label").isin(own)).withColumn("seq", F.lit(number)) for (number, name), own in parts.items()])
        for number, name in state["gone"]:
            if number > min(n for n, _ in parts):
                gone = self.spark.read.schema("id string, label string").parquet(f"{self.path}/{name}")
                old = F.col("seq") < number
                for i, label in (("id", "label"),) if kind == "nodes" else (("from_id", "from_type"), ("to_id", "to_type")):
                    hit = gone.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
                    rows = rows.join(hit, old & (F.col(i) == F.col("_i")) & (F.col(label) == F.col("_l")), "left_anti")
        several = [label for label, held in chosen.items() if len(held) > 1]
        if not several:
            return rows.select(*columns)
        many = F.col("label").isin(several)
        merged = merge_nodes(rows.where(many), last=not first) if kind == "nodes" else merge_edges(rows.where(many)) if not first else _first_edges(rows.where(many))
        return rows.where(~many).select(*columns).unionByName(merged.select(*columns))

    def read(self, labels: list[str] | None = None, first: bool = False) -> Graph:
        """The graph, or its nodes of some labels and edges between them; with ``first`` the first value of a property wins."""
        _, state = self._state()
        full = None if labels is None else [f"{self.namespace}.{x}" if self.namespace and "." not in x else x for x in labels]
        nodes, edges = self._rows("nodes", state, full, first), self._rows("edges", state, None, first)
        if full is not None:
            edges = edges.where(F.col("from_type").isin(full) & F.col("to_type").isin(full))
        if self.namespace:
            cut = lambda c: F.when(F.startswith(F.col(c), F.lit(f"{self.namespace}.")), F.substr(F.col(c), F.lit(len(self.namespace) + 2))).otherwise(F.col(c))
            nodes = nodes.withColumn("label", cut("label"))
            edges = edges.withColumn("from_type", cut("from_type")).withColumn("to_type", cut("to_type"))
        return Graph(nodes, edges)

    def versions(self) -> dict[str, dict[str, int]]:
        """How many versions each label has."""
        _, state = self._state()
        return {k: {label: len(held) for label, held in state[k].items()} for k in KINDS}

    def drop(self) -> None:
        self.manifest.drop()


def _first_edges(edges: DataFrame) -> DataFrame:
    picked = edges.groupBy(*ENDS).agg(F.min_by("properties", F.struct("seq", "id")).alias("properties"))
    return picked.withColumn("id", edge_id(F.col("properties"))).select(*EDGE_COLUMNS)
