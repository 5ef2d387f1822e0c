"""Paths by id and label, sub-patterns in conditions, and rules that are defined by themselves."""

import itertools
import random

import pytest

from graphloom.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, as_edges
from graphloom.plans import patterns, rules
from pyspark.sql import functions as F


def graph_of(spark, triples, extra=()):
    """Nodes are written ``Label:id``; edges get content ids."""
    names = sorted({x for a, _, b in triples for x in (a, b)} | set(extra))
    nodes = spark.createDataFrame([(n.split(":")[1], n, n.split(":")[0], {"size": str(len(n) + int(n.split(":")[1]))}) for n in names], NODE_SCHEMA)
    rows = spark.createDataFrame([(*reversed(a.split(":")), r, *reversed(b.split(":"))) for a, r, b in triples], "s string, st string, r string, o string, ot string")
    return Graph(nodes, as_edges(rows, F.col("s"), F.col("st"), F.col("r"), F.col("o"), F.col("ot")))


COLLIDING = [("Customer:1", "in", "Nation:5"), ("Nation:5", "in", "Region:2"), ("Supplier:5", "in", "Nation:7")]


def test_ids_shared_by_labels(spark):
    g = graph_of(spark, COLLIDING)
    fixed = patterns.Matcher(g).run("MATCH (s:Customer)-[:in]->(m)-[:in]->(o) RETURN o, o.label AS kind").collect()
    free = patterns.Matcher(g).run("MATCH (s:Customer)-[p:in*2..2]->(o) RETURN o, o.label AS kind").collect()
    assert [tuple(r) for r in free] == [tuple(r) for r in fixed] == [("2", "Region")]


def walks(triples, low, high, undirected, starts, ends):
    """All paths by brute force, edges numbered by their text."""
    hops = [(a, b, i) for i, (a, _, b) in enumerate(triples)] + ([(b, a, i) for i, (a, _, b) in enumerate(triples) if a != b] if undirected else [])
    out, paths = [], [((a,), ()) for a in {x for a, _, b in triples for x in (a, b)} if starts is None or a in starts]
    for n in range(high + 1):
        out += [(p[0], p[-1], n, p) for p, _ in paths if n >= low and (ends is None or p[-1] in ends)]
        paths = [((*p, b), (*used, i)) for p, used in paths for a, b, i in hops if a == p[-1] and i not in used]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_paths_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"{label}:{i}" for label in "AB" for i in range(4)]
    triples = sorted({(rng.choice(names), "r", rng.choice(names)) for _ in range(14)})
    g = graph_of(spark, triples)
    keys = lambda chosen: None if chosen is None else spark.createDataFrame([tuple(reversed(x.split(":"))) for x in chosen], "id string, label string")
    starts, ends = (rng.sample(names, 3) if seed % 2 else None), (rng.sample(names, 3) if seed > 0 else None)
    for low, high, undirected in ((1, 3, False), (0, 4, True)):
        got = patterns.variable_paths(g.edges, low, high, undirected, keys(starts), keys(ends)).collect()
        assert sorted((f"{r.start.label}:{r.start.id}", f"{r.end.label}:{r.end.id}", r.hops, tuple(f"{n.label}:{n.id}" for n in r.nodes)) for r in got if r.hops) == [
            w for w in walks(triples, low, high, undirected, starts and set(starts), ends and set(ends)) if w[2]
        ]


def test_exists(spark):
    g = graph_of(spark, [("A:1", "r", "B:1"), ("A:2", "r", "B:2"), ("B:1", "q", "C:1"), ("A:3", "r", "B:1")], extra=["B:9"])
    run = lambda where: {r.a for r in patterns.Matcher(g).run(f"MATCH (a:A)-[:r]->(b:B) WHERE {where} RETURN a").collect()}
    assert run("EXISTS { (b)-[:q]->(c) }") == {"1", "3"}
    assert run("not exists { (b)-[:q]->(c) }") == {"2"}
    assert run("EXISTS { (b)-[:q]->(c) } AND a.size > 5") == {"3"}
    assert run("EXISTS { (b)-[:q]->(c) } OR a.size == 5") == {"1", "2", "3"}
    assert run("EXISTS { (x:A)-[:r]->(b) WHERE x.size > 5 AND NOT EXISTS { (x)-[:q]->(y) } }") == {"1", "3"}
    # every shared variable counts: the pair (a, b) itself
    assert run("EXISTS { (a)-[:r]->(b) }") == {"1", "2", "3"}
    assert run("a.name <> 'and } EXISTS {' AND EXISTS { (b)-[:q]->(c) WHERE c.name <> '}' }") == {"1", "3"}
    with pytest.raises(patterns.PatternError):
        run("EXISTS { (x)-[:q]->(y) }")
    with pytest.raises(patterns.PatternError):
        run("EXISTS { (b)-[:q]->(c) ")


def test_patterns_in_any_order(spark):
    g = graph_of(spark, [("A:1", "r", "B:1"), ("B:1", "q", "C:1"), ("C:1", "s", "D:1")])
    assert patterns.Matcher(g).run("MATCH (c)-[:s]->(d), (a)-[:r]->(b), (b)-[:q]->(c) RETURN a, d").count() == 1


def rule(text):
    return rules.parse_rule(text)


FAR = {
    "base": "Define (s:A)-[p:far]->(o:A) { Structure { (s)-[:next]->(o) } Constraint { } }",
    "step": "Define (s:A)-[p:far]->(o:A) { Structure { (s)-[:far]->(m:A)\n (m)-[:far]->(o) } Constraint { } }",
}


@pytest.mark.parametrize("triples", [[(f"A:{i}", "next", f"A:{(i + 1) % 5}") for i in range(5)], [(f"A:{i}", "next", f"A:{i + 1}") for i in range(5)] + [("A:9", "next", "A:9")]])
def test_closure_of_cycles_and_chains(spark, triples):
    found = rules.derive_all(graph_of(spark, triples), {n: rule(x) for n, x in FAR.items()})
    pairs = {(r.from_id, r.to_id) for r in found.edges.where("label = 'far'").collect()}
    want = {(a.split(":")[1], b.split(":")[1]) for a, _, b in triples}
    while more := {(a, d) for (a, b), (c, d) in itertools.product(want, want) if b == c} - want:
        want |= more
    assert pairs == want
    assert found.edges.where("label = 'far'").count() == len(want)


def test_transitive_rule_is_a_closure(spark, monkeypatch):
    """No round of it goes over all that is known; nodes of other labels end no pair."""
    triples = [(f"A:{i}", "next", f"A:{i * i % 23}") for i in range(23)] + [(f"A:{i}", "next", f"A:{i + 1}") for i in range(30, 47)] + [("A:5", "next", "B:1"), ("B:1", "next", "A:6")]
    monkeypatch.setattr(rules.Delta, "evaluated", lambda *_: pytest.fail("semi-naive rounds"))
    found = rules.derive_all(graph_of(spark, triples), {n: rule(x) for n, x in FAR.items()}).edges.where("label = 'far'")
    step = {(int(a[2:]), int(b[2:])) for a, _, b in triples if a[0] == b[0] == "A"}
    want, new = dict.fromkeys(step, 1), step
    while new := {(a, d) for (a, b), (c, d) in itertools.product(new, step) if b == c} - want.keys():
        want |= dict.fromkeys(new, max(want.values()) + 1)
    assert sorted((int(r.from_id), int(r.to_id)) for r in found.collect()) == sorted(want)
    far = rules.closure(as_edges(spark.createDataFrame(sorted(step), "s long, o long"), F.col("s"), "A", "far", F.col("o"), "A"))
    assert {(int(r.from_id), int(r.to_id)): r.far for r in far.collect()} == want
    other = {**FAR, "step": FAR["step"].replace("(m:A)", "(m:A|B)")}
    assert rules.composes(rule(FAR["step"])) and not rules.composes(rule(other["step"])) and not rules.composes(rule(FAR["base"]))


def test_mutual_rules_and_strata(spark):
    g = graph_of(spark, [(f"A:{i}", "next", f"A:{i + 1}") for i in range(5)])
    text = {
        "even": "Define (s:A)-[p:even]->(o:A) { Structure { (s)-[:odd]->(m)\n (m)-[:next]->(o) } Constraint { } }",
        "odd": "Define (s:A)-[p:odd]->(o:A) { Structure { (s)-[:next]->(o) } Constraint { } }",
        "odd2": "Define (s:A)-[p:odd]->(o:A) { Structure { (s)-[:even]->(m)\n (m)-[:next]->(o) } Constraint { } }",
        "many": "Define (s:A)-[p:many]->(o:A) { Structure { (s)-[:odd]->(o) } Constraint { n = group(s).count(o)\n n > 2 } }",
    }
    known = {n: rule(x) for n, x in text.items()}
    assert rules.strata(known)[-1] == ["many"]
    found = rules.derive_all(g, known).edges
    odd = {(int(r.from_id), int(r.to_id)) for r in found.where("label = 'odd'").collect()}
    assert odd == {(i, j) for i in range(6) for j in range(6) if (j - i) > 0 and (j - i) % 2}
    assert {int(r.from_id) for r in found.where("label = 'many'").collect()} == {0}
    with pytest.raises(rules.RuleError):
        rules.ordered(known)
    with pytest.raises(rules.RuleError):
        rules.strata({"bad": rule("Define (s:A)-[p:far]->(o:A) { Structure { (s)-[:far]->(o) } Constraint { n = group(s).count(o)\n n > 2 } }")})
    with pytest.raises(rules.RuleError):
        rules.derive_all(g, {n: rule(x) for n, x in FAR.items()}, most=1)


def test_rules_keep_nothing_of_a_graph(spark):
    one = rule("Define (s:A)-[p:near]->(o:A) { Structure { (s)-[:next]->(o) } Constraint { } }")
    before = {v: list(x) for v, x in one.structure.nodes.items()}
    rules.RuleEngine(graph_of(spark, [("A:1", "next", "A:2")])).edges(one).count()
    assert one.structure.nodes == before


def test_concepts_that_rules_derive(spark):
    g = graph_of(spark, [("A:1", "next", "A:2"), ("A:2", "next", "A:3")])
    known = {
        "big": rule("Define (s:A)-[p:belongTo]->(o:Kind/big) { Structure { (s)-[:next]->(x) } Constraint { s.size > 4 } }"),
        "up": rule("Define (s:A)-[p:belongTo]->(o:Kind/up) { Structure { (s:A)-[:next]->(b:Kind/big) } Constraint { } }"),
    }
    known["up"].structure.nodes["b"] = ["A", "Kind/big"]
    made = rules.derive_all(g, known).edges.where("label = 'belongTo'").collect()
    assert {(r.from_id, r.to_id) for r in made} == {("2", "big"), ("1", "up")}


def test_facts_by_id_and_label(spark):
    g = graph_of(spark, COLLIDING)
    assert rules.reasoning(g, subject="5").count() == 2
    assert [r.o for r in rules.reasoning(g, subject=("5", "Nation")).collect()] == ["2"]
    assert EDGE_SCHEMA


def test_linking_from_text(spark):
    from graphloom.operators import retrieve
    from graphloom.plans.logicform import LogicFormRunner

    nodes = [("1", "Ann Lee", "Person", {"about": "paints large murals"}), ("2", "Ann Lee", "Firm", {}), ("3", "Bob", "Person", {}), ("4", "Oslo", "City", {})]
    g = Graph(spark.createDataFrame(nodes, NODE_SCHEMA), as_edges(spark.createDataFrame([("1", "4"), ("3", "4")], "s string, o string"), F.col("s"), "Person", "lives", F.col("o"), "City"))
    mentions = spark.createDataFrame([("q", "ANN LEE", "Person"), ("q", "ann lee", None), ("q", "large murals", "Person"), ("q", "nobody here", "Person")], "query_id string, mention string, type string")
    found = lambda **o: {(r.mention, r.id, r["rank"]) for r in retrieve.link_mentions(g, mentions, **o).collect()}
    # a name of the wrong type or of no wanted type counts for less
    assert found(least=0.8) == {("ANN LEE", "1", 1)}
    assert ("large murals", "1", 1) in found(described="about", least=0.5, k=3) or ("large murals", "1", 2) in found(described="about", least=0.5, k=3)
    assert ("ann lee", "2", 1) in found(least=0.3, excluded=["Person"], k_of={"Firm": 2})
    runner = LogicFormRunner(g)
    plan = "get_spo(s=s1:Person, p=p1:lives, o=o1:City[oslo])\nget(s1)"
    assert runner.run(plan).count() == 0
    assert {r.id for r in LogicFormRunner(g).linked(plan).collect()} == {"1", "3"}
    assert LogicFormRunner(g).linked(plan.replace("oslo", "paris")).count() == 0


def test_equal_names_need_no_vectors(spark, monkeypatch):
    from graphloom.operators import retrieve, search

    nodes = spark.createDataFrame([(str(i), f"Shop {i % 3}", ("Shop", "Firm")[i % 2], {}) for i in range(12)], NODE_SCHEMA)
    mentions = spark.createDataFrame([(f"q{i}", "sHOP 1", kind) for i, kind in enumerate(["Shop", "Firm", None, "Shop"])], "query_id string, mention string, type string")
    with_vectors = {tuple(r) for r in retrieve.link_mentions(Graph(nodes, None), mentions, least=0.25, k=20).select("query_id", "id", "label", F.round("score", 6)).where("label = 'Shop'").collect()}
    assert {("q0", "10", "Shop", 1.0), ("q2", "4", "Shop", 0.3)} < with_vectors
    monkeypatch.setattr(search, "top_vectors_batch", lambda *a: 1 / 0)
    rows = {tuple(r) for r in retrieve.link_mentions(Graph(nodes, None), mentions, least=0.25, k=2).select("query_id", "id", "rank").collect()}
    assert rows == {("q0", "10", 1), ("q0", "4", 2), ("q1", "1", 1), ("q1", "7", 2), ("q2", "1", 1), ("q2", "10", 2), ("q3", "10", 1), ("q3", "4", 2)}
