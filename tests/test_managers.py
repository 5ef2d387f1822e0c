"""Index managers and schema-constrained extraction."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import extract, search
from graphloom.plans.flow import INDEXES, IndexManager


def test_schema_constrained(spark):
    kind = "chunk_id string, name string, type string, properties map<string,string>"
    entities = spark.createDataFrame([("c1", "Ann", "Person", {"age": "3", "home": "Oslo, Rome", "secret": "x"}), ("c2", "ann", "Person", None), ("c1", "  ", "Person", {}), ("c1", "Odd", "Thing", {"age": "1"})], kind)
    events = spark.createDataFrame([("c1", "Party", "Event", {"host": "Ann", "when": "now"})], kind)
    relations = spark.createDataFrame([("c1", ["Ann", "Person", "lives in", "Oslo", "City"]), ("c1", ["Ann", "knows", "Bob"]), ("c1", ["Ann", "Person", "owns", "Rock", "Stone"])], "chunk_id string, fields array<string>")
    known = {"Person": {"age": "Text", "home": "City"}, "Event": {"host": "Person", "when": "Text"}, "City": {}}
    g = extract.schema_constrained(entities, events, relations, known)
    nodes = {(r.label, r.name): dict(r.properties) for r in g.nodes.collect()}
    assert nodes[("Person", "ann")] == {"age": "3"} or nodes.get(("Person", "Ann")) == {"age": "3"}
    assert {k[0] for k in nodes} == {"Person", "Event", "City"} and len(nodes) == 4
    edges = {(r.from_type, r.label, r.to_type, r.to_id) for r in g.edges.where("label <> 'source'").collect()}
    assert {e[:3] for e in edges} == {("Person", "home", "City"), ("Event", "host", "Person"), ("Person", "livesIn", "City")}
    assert g.edges.where("label = 'source' AND from_type = 'Person'").count() == 2
    assert extract.schema_constrained(entities.limit(0), None, None, known).nodes.count() == 0


def test_managers(spark):
    chunks = spark.createDataFrame([("1", "a", "Oslo is north of Rome.", "TEXT"), ("2", "b", "Tables are made of wood in Bergen.", "TEXT")], "id string, name string, content string, type string").withColumn("parent_id", F.lit(None).cast("string"))
    queries = spark.createDataFrame([(1, "wood of Bergen"), (2, "")], "query_id int, text string")
    for name in ("chunk", "atomic_query"):
        manager = IndexManager((name,))
        hits = manager.retrieve(manager.build(chunks), queries, 2).where("query_id = 1 AND rank = 1").collect()
        assert [r.id for r in hits] == ["2"], name
        assert manager.schema().types
    assert set(IndexManager(tuple(INDEXES)).schema().types) >= {"Chunk", "Table", "Outline", "Summary", "AtomicQuery"}
    with pytest.raises(KeyError):
        IndexManager(("none",))


def test_text_matches_of_labels(spark):
    nodes = spark.createDataFrame([("1", "A", "red house"), ("2", "B", "red house"), ("3", "A", "blue boat")], "id string, label string, name string")
    queries = spark.createDataFrame([(1, "the RED one"), (2, "none")], "query_id int, text string")
    assert [(r.query_id, r.id) for r in search.external_text_matches(nodes, queries, 3, ["A"]).collect()] == [(1, "1")]
