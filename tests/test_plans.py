"""Parsers, rules, logic forms, flows and streams."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import models
from graphloom.operators import fusion, retrieve, search
from graphloom.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph
from graphloom.plans import expressions, flow, logicform, patterns, rules, schema
from graphloom.streaming import incremental

SCHEMA = """namespace Risk

Person(person): EntityType
    properties:
        age(age): Integer
            constraint: NotNull
        kind(kind): Text
            constraint: MultiValue, Enum="a,b"
            index: TextAndVector
        hasPhone(phone): STD.ChinaMobile
    relations:
        CAU#leads(leads): Person
            properties:
                amount(amount): Float
        holds(holds): Device
            rule: [[
                Define (s:Person)-[p:holds]->(o:Device) { Structure { (s)-[:has]->(o) } }
            ]]
Employee(employee) -> Person:
    properties:
        desk(desk): Text
Device(device): EntityType
"""


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("p1", "Ann", "Person", {"age": "30"}), ("p2", "Bob", "Person", {"age": "9"}), ("d1", "Phone", "Device", {}), ("d2", "Pad", "Device", {}), ("a1", "App", "App", {"risk": "x"})]
    edges = [("e1", "p1", "Person", "d1", "Device", "has", {"n": "2"}), ("e2", "p2", "Person", "d1", "Device", "has", {"n": "3"}), ("e3", "p1", "Person", "d2", "Device", "has", {"n": "5"}), ("e4", "d1", "Device", "a1", "App", "runs", {})]
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))


def test_schema_language(spark, graph):
    c = schema.parse(SCHEMA)
    assert c.namespace == "Risk" and set(c.types) == {"Person", "Employee", "Device"}
    person = c.types["Person"]
    assert person.properties["kind"].constraints == {"MultiValue": True, "Enum": ["a", "b"]}
    assert person.relations["leads"][0].family == "CAU" and "amount" in person.relations["leads"][0].sub
    assert person.relations["holds"][0].rule.startswith("Define")
    assert set(c.predicates("Employee")) == {"age", "kind", "hasPhone", "desk"}
    assert c.predicate_between("Person", "Device") == ["holds"] and c.objects_of("Person", "leads") == ["Person"]
    assert [tuple(r) for r in c.view(graph.nodes, "Person").select("id", "age").orderBy("id").collect()] == [("p1", 30), ("p2", 9)]
    broken = c.violations(spark.createDataFrame([("x", "x", "Person", {"kind": "a,z"})], NODE_SCHEMA)).collect()
    assert {(r.property, r.constraint) for r in broken} == {("age", "NotNull"), ("kind", "Enum")}
    for bad in ("A: EntityType", "namespace X\nA: Odd", "namespace X\nA(a): EntityType\n    properties:\n        x(x): Text\n            index: Odd"):
        with pytest.raises(schema.SchemaError):
            schema.parse(bad)
    newer = schema.parse(SCHEMA.replace("desk(desk): Text", "desk(desk): Integer") + "\nRoom(room): EntityType\n")
    assert schema.changes(c, newer) == {"create": ["Room"], "update": ["Employee.desk"], "delete": []}


def test_expressions(spark):
    run = lambda text, **p: spark.range(1).select(expressions.lower(text, lambda n: F.lit(5), p, "20240101")).first()[0]
    assert run("1 + 2 * 3") == 7 and run("(1 + 2) * -3") == -9
    assert run("a > 4 and not a == 6 or 1 > 2") is True
    assert run("a in $ids", ids=[1, 5]) is True and run("'abc' like 'a%'") is True
    assert run("date_diff(now(), '20231230')") == 2
    assert run("rule_value(a > 1, 'x', 'y')") == "x"
    for bad in ("__import__('os')", "a +", "exec('x')", "a; b"):
        with pytest.raises(expressions.ExpressionError):
            run(bad)


def test_patterns(graph):
    run = patterns.Matcher(graph).run
    assert {tuple(r) for r in run("MATCH (s:Person)-[p:has]->(o:Device) WHERE p.n > 2 RETURN s, o.name AS d").collect()} == {("p2", "Phone"), ("p1", "Pad")}
    assert run("MATCH (a:App)<-[:runs]-(d)<-[:has]-(s:Person) RETURN s, a").count() == 2
    assert run("MATCH (s:Person|Device) RETURN s.name").count() == 4
    assert {r.o for r in run("MATCH (s:Person)-[p*1..2]->(o) WHERE s.name == 'Ann' RETURN o").collect()} == {"d1", "d2", "a1"}
    assert run("MATCH (s:Person)-[:has]->(d:Device), (o:Person)-[:has]->(d) RETURN s, o").count() == 5
    with pytest.raises(patterns.PatternError):
        run("MATCH (s:Person), (d:Device) RETURN s, d")
    paths = patterns.variable_paths(graph.edges, 1, 2, False)
    assert {r.sentence for r in patterns.path_sentences(paths, graph.nodes).collect()} >= {"Ann has Phone; Phone runs App"}


def test_rules(graph):
    rule = rules.parse_rule("""Define (s:Person)-[p:belongTo]->(o:`Kind/Heavy`) {
        Structure { (s)-[f:has]->(d:Device) }
        Constraint {
            n = group(s).sum(f.n)
            R1("many"): n > 4
        }
        Action { createNodeInstance(id=s.name, type=Note) }
    }""")
    engine = rules.RuleEngine(graph, {"n": "double"})
    assert [(r.from_id, r.to_id) for r in engine.edges(rule).collect()] == [("p1", "Heavy")]
    assert [(r.id, r.label) for r in engine.acted(rule).nodes.collect()] == [("Ann", "Note")]
    first = rules.parse_rule("Define (s:Person)-[p:near]->(o:Person) { Structure { (s)-[:has]->(d:Device)\n (o)-[:has]->(d) } }")
    second = rules.parse_rule("Define (s:Person)-[p:twice]->(o:Person) { Structure { (s)-[:near]->(o) } }")
    assert rules.ordered({"b": second, "a": first}) == ["a", "b"]
    derived = rules.derive_all(graph, {"b": second, "a": first})
    assert derived.edges.where("label = 'twice'").count() == 4
    assert rules.reasoning(graph, predicate="runs").count() == 1
    with pytest.raises(rules.RuleError):
        rules.parse_rule("nothing")


def test_logic_forms(graph):
    plan = "Step1: who?\nAction1: get_spo(s=s1:Person, p=p1:has, o=o1:Device[Phone], s.age>=10)\nStep2: say\nAction2: output(s1)"
    assert [tuple(r) for r in logicform.LogicFormRunner(graph).run(plan).collect()] == [("s1", "p1", "Ann")]
    count = "get_spo(s=s1:Person, p=p1:has, o=o1:Device)\nget_spo(s=o1:Device, p=p2:runs, o=a1:App)\nMath(content=[`o1`], target=count)->n"
    assert logicform.LogicFormRunner(graph).run(count).first().n == 1
    term = logicform.parse_term("s1:Person|Device[`A, b`][1|2]")
    assert (term.alias, term.types, term.name, term.ids) == ("s1", ["Person", "Device"], "A, b", ["1", "2"])
    assert logicform.dependencies(logicform.parse_plan(count)) == {0: set(), 1: {0}, 2: {0, 1}}
    with pytest.raises(logicform.LogicFormError):
        logicform.parse_plan("Step1: x\nStep2: y\nAction1: output(a)")
    with pytest.raises(logicform.LogicFormError):
        logicform.parse_action("verify(a)")


def test_flow(spark):
    order, inputs = flow.parse_flow("a,b->c;d")
    assert inputs == {"a": [], "b": [], "c": ["a", "b"], "d": []} and order.index("c") > order.index("b")
    with pytest.raises(ValueError):
        flow.parse_flow("a->b;b->a")
    n = lambda k: lambda _: spark.createDataFrame([(k,)], "x string")
    made = flow.run_flow("a,b->c;d", {"a": n("a"), "b": n("b"), "c": lambda i: i[0].unionByName(i[1]), "d": n("d")})
    assert sorted(r.x for r in made.collect()) == ["a", "b", "d"]


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "y", 5.0)], "query_id int, list_id string, id string, score double")
    assert {r.id: r.score for r in fusion.rrf(hits).collect()} == {"x": 1.0, "y": 1.5}
    assert {r.id: r.score for r in fusion.min_max_sum(hits).collect()} == {"x": 1.0, "y": 1.0}
    chosen = fusion.selected(fusion.ranked(hits).where("list_id = 'a'"), None, 1)
    assert [r.id for r in chosen.collect()] == ["x"]


def test_retrieval(spark, graph):
    mine = spark.createDataFrame([("p1", "Person")], "id string, label string")
    got = retrieve.fuzzy_one_hop(graph, mine, "Ann has Phone", 5, 0.1).collect()
    assert got and got[0].text == "(Ann has Phone)"
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.5, 2)], "query_id int, id string, score double, rank int")
    best = spark.createDataFrame([(1, "z", 3.0, 1)], hits.schema)
    assert {r.id for r in retrieve.with_text_hit(hits, best, 2).collect()} == {"a", "z"}


def test_pagerank_mass(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c")], "src string, dst string")
    ids = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    for directed in (True, False):
        ranks = search.pagerank(edges, ids, ids.where("id = 'a'"), 0.85, 7, directed)
        assert ranks.agg(F.sum("score")).first()[0] == pytest.approx(1.0)


def test_models(spark):
    vec = spark.range(1).select(models.model("embed")(F.lit("some words here"))).first()[0]
    assert len(vec) == 64 and sum(x * x for x in vec) == pytest.approx(1.0)
    with pytest.raises(KeyError):
        models.model("absent")
    models.register("mine", lambda c: c)
    assert models.model("mine")(3) == 3


def test_incremental_build(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    build = lambda rows: rows.select("k")
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "k string").coalesce(1)
    frame(["a", "b", "a"]).write.parquet(source)
    for extra in (None, ["b", "c"]):
        if extra:
            frame(extra).write.mode("append").parquet(source)
        incremental.build_incrementally(incremental.log_stream(spark, source, frame(["a"]).schema, 10), "k", build, out, state)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
