"""Hubs: what many nodes share multiplies rows only at the end, in several tasks."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph, as_edges, as_nodes
from graphloom.plans import patterns


@pytest.fixture(scope="module")
def star(spark):
    leaves = spark.range(60).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"), F.when(F.col("id") < 20, "h0").otherwise("h1").alias("h"))
    hubs = spark.createDataFrame([("h0", "top"), ("h1", "top")], "h string, t string")
    nodes = as_nodes(leaves, F.col("s"), "Leaf").unionByName(as_nodes(hubs, F.col("h"), "Hub")).unionByName(as_nodes(hubs.select("t").distinct(), F.col("t"), "Top"))
    return Graph(nodes, as_edges(leaves, F.col("s"), "Leaf", "in", F.col("h"), "Hub").unionByName(as_edges(hubs, F.col("h"), "Hub", "in", F.col("t"), "Top")))


@pytest.mark.parametrize("hot", [1, 1000])
def test_hubs_give_all_pairs(star, monkeypatch, hot):
    monkeypatch.setattr(patterns, "HOT", hot, raising=False)
    hub = {i: "h0" if i < 20 else "h1" for i in range(60)}
    got = patterns.Matcher(star).run("MATCH (a:Leaf)-[:in]->(n:Hub), (n)<-[:in]-(b:Leaf) WHERE a.id == 's3' RETURN a, b").collect()
    assert sorted(r.b for r in got) == sorted(f"s{i}" for i in range(20))
    paths = patterns.Matcher(star).bind(patterns.parse("MATCH (a:Leaf)-[p:in*1..4]-(b:Leaf) RETURN a, b")).select("a_id", "b_id", "p_hops").collect()
    want = {(f"s{i}", f"s{j}", 2 if hub[i] == hub[j] else 4) for i in range(60) for j in range(60) if i != j}
    assert len(paths) == len(want) and {tuple(r) for r in paths} == want


def test_hot_keys_go_to_several_tasks(spark, monkeypatch):
    """All pairs of one key are no longer made by one task."""
    monkeypatch.setattr(patterns, "HOT", 10)
    rows = spark.range(400).select(F.lit("k").alias("k"), F.col("id").alias("a"))
    got = patterns.many_to_many(rows, spark.range(50).select(F.lit("k").alias("k"), F.col("id").alias("b")), ["k"], ["a"])
    per = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in per) == 20_000 and max(r[1] for r in per) < 20_000


def test_leaves_are_not_inside_paths(star):
    """Frontiers of two edges hold no way from leaf to leaf: 60 + 60 rows, not thousands."""
    e = star.edges
    one = e.select(patterns._key("from_id", "from_type").alias("a"), patterns._key("to_id", "to_type").alias("b"), "label", F.col("id").alias("eid"))
    one = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "label", "eid"))
    first = patterns._keys(star.nodes.where("label = 'Leaf'"), "b")
    ahead = patterns._frontiers(one, first, 2, patterns._within(one, first, 3), 4, patterns._inner(one))
    assert [x.count() for x in ahead] == [60, 60]


def test_nodes_are_joined_to_halves_of_paths(star):
    """Pairs are made last: no join, and no taking apart of arrays, sees a row for each of them."""
    rows = patterns.Matcher(star).bind(patterns.parse("MATCH (a:Leaf)-[p:in*0..4]-(b:Leaf) RETURN a, b")).select("a_id", "b_id", "p_hops", "a_name", "b_properties")
    plan = rows._jdf.queryExecution().optimizedPlan()
    assert "arrays_overlap" not in plan.toString()
    # below the union of all lengths, so that none joins what it gives
    assert plan.toString().lstrip().startswith(("Union", "Project")) and "Join" not in plan.toString().split("Union")[0]
    assert rows.count() == 60 * 59 + 60


def test_plain_rules_make_pairs_once_without_a_shuffle(spark, monkeypatch):
    """Rules over rules are unfolded; pairs by several ways count once; rules that are not plain give the same."""
    from graphloom.plans import rules

    ways = [("s0", "h0"), ("s1", "h0"), ("s1", "h1"), ("s2", "h1"), ("s2", "h1"), ("s3", "h2")]
    leaves, tops = spark.createDataFrame(ways, "s string, h string"), spark.createDataFrame([("h0", "t"), ("h1", "t"), ("h1", "u"), ("h2", "u")], "h string, t string")
    node = lambda rows, c, label: as_nodes(rows.select(c).distinct(), F.col(c), label, properties=F.create_map(F.lit("n"), F.substring(F.col(c), 2, 1)))
    g = Graph(node(leaves, "s", "Leaf").unionByName(node(tops, "h", "Hub")).unionByName(node(tops, "t", "Top")), as_edges(leaves, F.col("s"), "Leaf", "in", F.col("h"), "Hub").unionByName(as_edges(tops, F.col("h"), "Hub", "of", F.col("t"), "Top")))
    known = {
        "a": rules.parse_rule("Define (s:Leaf)-[p:near]->(o:Leaf) { Structure { (s)-[:in]->(n:Hub)\n (o)-[:in]->(n) } Constraint { s.n < 3 } }"),
        "b": rules.parse_rule("Define (s:Leaf)-[p:under]->(o:Top) { Structure { (s)-[:near]->(x:Leaf)\n (x)-[:in]->(n:Hub)\n (n)-[:of]->(o) } Constraint { x.n > 0 } }"),
    }
    types = {"n": "int"}
    made = rules.derive_all(g, known, types=types).edges.where("label IN ('near', 'under')").select("from_id", "label", "to_id")
    got = sorted(map(tuple, made.collect()))
    hub, top = {(s, h) for s, h in ways}, {("h0", "t"), ("h1", "t"), ("h1", "u"), ("h2", "u")}
    near = {(s, o) for s, n in hub for o, m in hub if n == m and s < "s3"}
    under = {(s, t) for s, x in near for y, h in hub for k, t in top if x == y and h == k and x > "s0"}
    want = sorted([(s, "near", o) for s, o in near] + [(s, "under", o) for s, o in under])
    assert got == want
    assert rules.plain(known["a"]) and not rules.plain(rules.parse_rule("Define (s:Leaf)-[p:near]->(o:Leaf) { Structure { (s)-[:in]->(n:Hub)\n (o)-[:in]->(n) } Constraint { s.n < o.n } }"))
    # no source of one hub is shuffled to tell its pairs apart
    single = Graph(g.nodes, g.edges.where("from_id <> 's1'"))
    assert "Aggregate" not in rules.RuleEngine(single, types).pairs(known["a"])._jdf.queryExecution().optimizedPlan().toString()
