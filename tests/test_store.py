"""The stored graph through upserts, deletions and compaction."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators.graph import NODE_SCHEMA, Graph, as_edges
from graphloom.operators.store import GraphStore


def graph(spark, nodes, edges=()):
    n = spark.createDataFrame([(i, name, label, p) for label, i, name, p in nodes], NODE_SCHEMA)
    e = spark.createDataFrame(list(edges), "st string, s string, r string, ot string, o string")
    return Graph(n, as_edges(e, F.col("s"), F.col("st"), F.col("r"), F.col("o"), F.col("ot")))


def seen(g):
    nodes = {(r.label, r.id): (r.name, dict(r.properties)) for r in g.nodes.collect()}
    edges = sorted((r.from_type, r.from_id, r.label, r.to_type, r.to_id) for r in g.edges.collect())
    assert g.nodes.count() == len(nodes)
    return nodes, edges


@pytest.mark.parametrize("namespace", [None, "Space"])
def test_life(spark, tmp_path, namespace):
    store = GraphStore(spark, str(tmp_path / "g"), namespace, fan_in=3)
    assert seen(store.read()) == ({}, [])
    store.upsert(graph(spark, [("A", "1", "one", {"x": "1", "y": "1"}), ("B", "1", "b", {})], [("A", "1", "r", "B", "1")]))
    store.upsert(graph(spark, [("A", "1", "uno", {"x": "2", "z": "3"}), ("A", "2", "two", {})], [("A", "1", "r", "B", "1"), ("A", "2", "r", "B", "1")]))
    nodes, edges = seen(store.read())
    assert nodes == {("A", "1"): ("uno", {"x": "2", "y": "1", "z": "3"}), ("A", "2"): ("two", {}), ("B", "1"): ("b", {})}
    assert edges == [("A", "1", "r", "B", "1"), ("A", "2", "r", "B", "1")]
    assert seen(store.read(first=True))[0][("A", "1")] == ("one", {"x": "1", "y": "1", "z": "3"})
    assert set(seen(store.read(["B"]))[0]) == {("B", "1")} and seen(store.read(["B"]))[1] == []
    # only the labels that an upsert brings get a version
    assert sorted(store.versions()["nodes"].values()) == [1, 2]
    store.delete(spark.createDataFrame([("1", "A"), ("9", "B")], "id string, label string"))
    nodes, edges = seen(store.read())
    assert set(nodes) == {("A", "2"), ("B", "1")} and edges == [("A", "2", "r", "B", "1")]
    # a node that comes back has none of its earlier values
    store.upsert(graph(spark, [("A", "1", "again", {"w": "0"})]))
    assert seen(store.read())[0][("A", "1")] == ("again", {"w": "0"})
    assert max(store.versions()["nodes"].values()) == 1  # the third version of A was merged
    before = seen(store.read())
    store.compact()
    assert seen(store.read()) == before and store._state()[1]["gone"] == []
    store.drop()
    assert seen(store.read()) == ({}, [])


def test_encoding(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    row = F.struct(F.lit("t").alias("text"), F.lit(3).alias("n"), F.array(F.lit(1), F.lit(2)).alias("list"), F.lit(None).cast("string").alias("none"))
    nodes = spark.range(1).select(F.lit("1").alias("id"), F.lit("n").alias("name"), F.lit("A/b c").alias("label"), row.alias("properties"))
    store.upsert(Graph(nodes, Graph.empty(spark).edges))
    assert seen(store.read())[0] == {("A/b c", "1"): ("n", {"text": "t", "n": "3", "list": "[1,2]"})}


def test_two_writers(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    store.upsert(graph(spark, [("A", "1", "a", {})]))
    version, state = store._state()
    store.upsert(graph(spark, [("A", "2", "b", {})]))
    with pytest.raises(Exception, match="exists"):
        store.manifest.write(state, version)
    assert store.read().nodes.count() == 2
