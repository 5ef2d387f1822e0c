"""The answer side, cuts by meaning, external graphs, JSON repair and tables by row and column."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import metrics, text
from graphloom.operators import extract, graph, split
from graphloom.operators.graph import Graph, as_edges, as_nodes
from graphloom.plans import flow, logicform, solve


def test_cuts_by_meaning_recur_and_keep_the_text(spark):
    long = "".join(f"Sentence number {i:04d} of it. " for i in range(200))
    docs = spark.createDataFrame([("a", "A", long), ("b", "B", "short"), ("c", "C", "x" * 900)], "id string, name string, content string")
    got = split.by_meaning(docs, 300).collect()
    assert sum(len(r.content) for r in got) == len(long) + 5 + 900
    assert max(len(r.content) for r in got if r.content[0] != "x") < 300
    assert [r.content for r in got if r.id == "c"] == ["x" * 900]  # no place inside, so it stays whole


def test_json_is_repaired(spark):
    rows = spark.createDataFrame([(0, '{"a": 1}'), (1, '```json\n{"a": 2,}\n```'), (2, 'so: {"a": 3, "b": None} ok'), (3, '{"a": 4'), (4, "none"), (5, None)], "i int, t string")
    got = dict(rows.select("i", text.parsed(F.col("t"), "a int")["a"]).collect())
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: None, 5: None}


def test_external_graph_of_json_lines(spark, tmp_path):
    (tmp_path / "n.json").write_text("\n".join(json.dumps(x) for x in [{"id": "1", "label": "P", "properties": {"k": "v"}}, {"name": "no id", "label": "P"}]))
    (tmp_path / "e.json").write_text(json.dumps({"from_id": "1", "from_type": "P", "to_id": "2", "to_type": "P", "label": "knows"}))
    g = graph.external_graph(spark, str(tmp_path / "n.json"), str(tmp_path / "e.json"))
    assert [tuple(r) for r in g.nodes.collect()] == [("1", "1", "P", {"k": "v"})]
    e = g.edges.first()
    assert (e.from_id, e.label, e.to_id, e.properties) == ("1", "knows", "2", {}) and e.id


def test_tables_by_row_and_column(spark):
    tables = spark.createDataFrame([("t", "T", "| a | b |\n|-|-|\n| 1 | 2 |\n| 3 | 4 |")], "id string, name string, content string")
    g = extract.table_graph(tables, "row_col")
    assert {r.properties["content"] for r in g.nodes.where("label = 'Chunk'").collect()} == {"a: 1; b: 2", "a: 3; b: 4", "1; 3", "2; 4"}
    assert g.edges.where("label = 'sourceTable'").count() == 4


def test_a_unit_for_each_triple(spark):
    facts = spark.createDataFrame([("c", "Ann", "owns", "Car", "now")], "chunk_id string, s string, p string, o string, condition string")
    g = extract.knowledge_units(extract.triple_units(facts))
    assert g.nodes.where("label = 'KnowledgeUnit'").first().name == "Ann owns Car now"
    assert {r.from_id for r in g.edges.where("label = 'source'").collect()} == {"ann", "car"}


def test_rouge_counts_chinese_characters(spark):
    row = spark.createDataFrame([("我爱北京", "我在北京", "a b", "a c")], "a string, b string, c string, d string")
    got = row.select(metrics.rouge_l("a", "b"), metrics.rouge_l("c", "d")).first()
    assert tuple(got) == (0.75, 0.5)


def small(spark):
    people = spark.createDataFrame([("1", "Ann", "30"), ("2", "Bob", "50")], "i string, n string, age string")
    nodes = as_nodes(people, F.col("i"), "Person", F.col("n"), F.create_map(F.lit("age"), F.col("age")))
    return Graph(nodes, as_edges(people.where("i = '1'"), F.col("i"), "Person", "knows", F.lit("2"), "Person"))


def test_steps_until_the_planner_ends(spark):
    steps = ["get_spo(s=s1:Person, p=p1:knows, o=o1:Person)", "output(o1)"]
    got = solve.iterative(logicform.LogicFormRunner(small(spark)), lambda done: steps[len(done)] if len(done) < 2 else None)
    assert [tuple(r) for r in got.collect()] == [("o1", "2", "Bob")]
    with pytest.raises(solve.UnfinishedError):
        solve.iterative(logicform.LogicFormRunner(small(spark)), lambda done: steps[0], most=2)


def test_binary_expressions_keep_commas_of_values(spark):
    got = logicform.parse_binary("left_expr=o1, right_expr=x，y， op=等于")
    assert (got.left, got.right, got.op) == (["o1"], "x，y", "等于")
    assert logicform.parse_binary("left_expr=a,b,a, op=大于").left == ["a", "b"]
    with pytest.raises(logicform.LogicFormError):
        logicform.parse_binary("right_expr=1, op=>")
    plan = "get_spo(s=s1:Person, p=p1:knows, o=o1:Person)\nDeduce(left_expr=o1.age, right_expr=40, op=>)->old"
    assert [r.o1 for r in logicform.LogicFormRunner(small(spark)).run(plan).collect()] == ["2"]


def test_answers_come_from_the_nearest_sentence(spark):
    queries = spark.createDataFrame([(1, "where is the red house"), (2, "who")], "query_id int, text string")
    found = spark.createDataFrame([(1, "A cat sat. The red house is here.")], "query_id int, context string")
    assert dict(solve.generated(queries, found).collect()) == {1: "The red house is here.", 2: None}


def test_a_break_stops_later_components(spark):
    one = lambda n: lambda _: spark.createDataFrame([(n,)], "n int")
    parts = {"a": one(1), "b": one(2)}
    assert sorted(r.n for r in flow.run_flow("a->b", parts).collect()) == [2]
    assert [r.n for r in flow.run_flow("a->b", parts, {"a": lambda d: d.count() == 1}).collect()] == [1]
