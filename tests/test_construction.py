"""Golden cases of scans, readers, splitters, mappings and graph operators."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions import metrics
from graphloom.functions import text as tx
from graphloom.operators import extract, mapping, search, split
from graphloom.operators import graph as gr
from graphloom.operators.graph import Graph, as_edges, as_nodes
from graphloom.sources import read, scan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_names(spark):
    assert one(spark, tx.phrase(F.lit(" Hello, World-9 "))) == "hello  world 9"
    assert one(spark, tx.camel_case(F.lit("located in Place"))) == "locatedInPlace"
    assert one(spark, tx.snake_case(F.lit("myFieldName"))) == "my_field_name"
    assert tx.vector_field("myField") == "_my_field_vector"
    assert one(spark, tx.abbreviated(F.lit("abcdefghijk"))) == "abcde...ghijk"
    assert one(spark, tx.abbreviated(F.lit("abcdefghij"))) == "abcdefghij"
    assert one(spark, tx.append_value(F.lit("a,b"), F.lit("b"))) == "a,b"
    assert one(spark, tx.recalled_label(F.array(F.lit("Entity"), F.lit("Person")))) == "Person"


def test_answers(spark):
    f1 = lambda a, b: one(spark, tx.token_f1(F.lit(a), F.lit(b)))
    assert f1("The cat sat", "cat sat down") == pytest.approx(0.8)
    assert f1("yes", "yes it is") == 0.0 and f1("Yes.", "yes") == 1.0
    assert one(spark, tx.normalized_answer(F.lit("An Apple, a Day"))) == "apple day"
    assert one(spark, tx.normalized_answer(F.lit("北京"))) == "北 京"
    assert one(spark, tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, tx.boxed(F.lit(r"so \boxed{42}."))) == "42"
    assert one(spark, tx.tagged(F.lit("<a>x</a> <a>y</a>"), "a")) == ["x", "y"]
    frame = spark.createDataFrame([("a b c d", "a c d")], "p string, g string")
    assert frame.select(metrics.rouge_l("p", "g")).first()[0] == pytest.approx(6 / 7)


def test_table_scans(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,title,text\n1,one,"a\nb"\n2,two,01\n')
    rows = scan.text_table(spark, str(path))
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("1", "one", "a\nb"), ("2", "two", "01")]
    assert {r.content for r in scan.cells(rows, ["title", "text"]).collect()} == {"one", "two", "a\nb", "01"}
    assert scan.positional(rows, {1: "name"}).columns == ["name"]
    assert scan.json_rows(spark, '[{"a": 1}, {"a": 2}]').count() == 2
    assert scan.json_rows(spark, '{"a": 1}').count() == 1
    with pytest.raises(ValueError):
        scan.json_rows(spark, "[1, 2]")
    numbered = spark.range(10).withColumnRenamed("id", "n")
    assert sum(scan.shard(numbered, "n", i, 3).count() for i in range(3)) == 10
    assert scan.partition_rows(spark.createDataFrame([(1, "a"), (2, "b")], "x int, dt string"), "dt='a'", ["x"]).collect()[0].x == 1


def test_triples_to_entities(spark):
    lines = spark.createDataFrame([("e\tarea\t2018年-5",), ("e\tname\tX",), ("bad\tline",)], "value string")
    got = scan.entity_rows(scan.split_triples(lines)).first()
    assert got.id == "e" and got.properties == {"2018年area": "5", "name": "X"}


MARKDOWN = """Intro line

# A
text a
| x | y |
| - | - |
| 1 | 2 |
after
## B
text b
#### deep
more
"""


def test_markdown_sections(spark):
    rows = read.sections(spark.createDataFrame([("d", MARKDOWN)], "id string, text string"), "id", "text").orderBy("ordinal").collect()
    assert [(r.kind, r.path) for r in rows] == [("section", ""), ("section", "A"), ("table", "A"), ("section", "A / B")]
    assert rows[3].content == "text b\n#### deep\nmore"
    assert (rows[2].before_text, rows[2].after_text) == ("text a", "after")
    graph = read.document_graph(read.sections(spark.createDataFrame([("d", MARKDOWN)], "id string, text string"), "id", "text"))
    labels = {r.label: r.n for r in gr.type_counts(graph).collect()}
    assert labels["hasChild"] == labels["hasParent"] == 1 and labels["Table"] == 1
    cells = extract.table_cells(read.section_chunks(read.sections(spark.createDataFrame([("d", MARKDOWN)], "id string, text string"), "id", "text")).where("type = 'TABLE'"))
    assert [(r.header, r.value) for r in cells.orderBy("row", "column").collect()] == [("x", "1"), ("y", "2")]


def test_html_tables(spark):
    html = "<html><body><h1>T</h1><p>before</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><script>x()</script></body></html>"
    parts = read.html_parts(html)
    assert parts == [("title", 1, "T"), ("text", 0, "before"), ("table", 0, "| a | b |\n| --- | --- |\n| 1 | 2 |")]


def test_splitters(spark):
    docs = spark.createDataFrame([("d", "n", "One two. Three four! Five six? Seven.")], "id string, name string, content string")
    rows = split.by_sentences(docs, 20, 8).collect()
    assert rows[0].id == "d" and all(len(r.content) <= 20 for r in rows)
    text = "".join(r.content for r in rows)
    assert all(s in text for s in ("One two.", "Three four!", "Five six?", "Seven."))
    fixed = split.by_length(docs, 10, 4).orderBy("k").collect()
    assert [r.content for r in fixed][:2] == ["One two. T", "o. Three f"]
    with pytest.raises(ValueError):
        split.by_length(docs, 4, 4)
    table = "| h |\n| - |\n" + "\n".join(f"| {i} |" for i in range(6))
    pieces = one(spark, split.markdown_table(F.lit(table), 12))
    assert all(p.startswith("| h |\n| - |\n") for p in pieces) and sum(p.count("\n") - 1 for p in pieces) == 6


def test_mapping_records(spark):
    rows = spark.createDataFrame([("1", "A", "x, y,x")], "id string, name string, product string")
    g = mapping.map_records(rows, "Company", {"id": "id", "name": "name", "product": "product"}, {"product": "Product"})
    assert sorted(r.to_id for r in g.edges.collect()) == ["x", "y"]
    assert g.nodes.first().properties == {"product": "x, y,x"}
    with pytest.raises(ValueError):
        mapping.map_records(rows, "Company", {"id": "id", "odd": "name"}, allowed={"product"})


def test_mapping_spo(spark):
    rows = spark.createDataFrame([("s", "p", "o", None, "T", json.dumps({"k": 1}))], "s string, p string, o string, st string, ot string, props string")
    g = mapping.map_spo(rows, "s", "p", "o", "st", "ot", json="props")
    e = g.edges.first()
    assert (e.from_type, e.to_type, e.properties) == ("Others", "T", {"k": "1"})
    with pytest.raises(ValueError):
        mapping.map_spo(rows, "s", "p", "o", json="props", properties=["st"])


def test_hypernyms(spark):
    g = mapping.hypernyms(spark.createDataFrame([("a-b-c",), ("a-d",)], "path string"), "path")
    assert {(r.id, r.name) for r in g.nodes.collect()} == {("a", "a"), ("a-b", "b"), ("a-b-c", "c"), ("a-d", "d")}
    assert {(r.from_id, r.to_id) for r in g.edges.collect()} == {("a-b", "a"), ("a-b-c", "a-b"), ("a-d", "a")}


def test_upsert_twice_is_once(spark):
    nodes = spark.createDataFrame([("1", "n", "L", {"a": "1"}), ("2", "m", "L", {"b": "2"})], gr.NODE_SCHEMA)
    edges = as_edges(spark.createDataFrame([("1", "2")], "a string, b string"), F.col("a"), "L", "r", F.col("b"), "L")
    new = Graph(nodes, edges)
    once = Graph.empty(spark).upsert(new)
    twice = once.upsert(new)
    assert once.nodes.count() == twice.nodes.count() == 2
    assert once.edges.first().id == twice.edges.first().id == edges.first().id
    assert twice.without(spark.createDataFrame([("L", "1")], "label string, id string")).edges.count() == 0


def test_validity(spark):
    nodes = spark.createDataFrame([("1", "n", "Known", {}), ("2", "n", "Odd", {}), (None, "n", "Known", {}), ("", "n", "Known", {})], gr.NODE_SCHEMA)
    got = gr.valid(Graph(nodes, Graph.empty(spark).edges), ["Known"], "ns").nodes.collect()
    assert {(r.id, r.label) for r in got} == {("1", "ns.Known"), ("2", "ns.Others")}


def test_extraction(spark):
    entities = spark.createDataFrame([("c", "Acme", "Company", "d"), ("c", "Bob", "Person", None)], "chunk_id string, name string, type string, description string")
    facts = spark.createDataFrame([("c", "acme", "hires now", "Bob"), ("c", "Bob", "knows", "Zoe"), ("c", "", "x", "y")], "chunk_id string, s string, p string, o string")
    official = spark.createDataFrame([("Acme", "Company", "Acme Corp", 0), ("Acme", "Company", "Acme Inc", 1)], "name string, type string, official string, seq int")
    g = extract.assembled(entities, facts, official)
    edges = {(r.from_id, r.from_type, r.label, r.to_id, r.to_type) for r in g.edges.collect()}
    assert ("acme", "Company", "hiresNow", "bob", "Person") in edges
    assert ("bob", "Person", "knows", "zoe", "Others") in edges
    assert ("zoe", "Others", "source", "c", "Chunk") in edges
    assert ("acme", "Company", "OfficialName", "acme inc", "Company") in edges
    nested = extract.nested_objects(spark.createDataFrame([("e", "T", {"name": "E", "in": '{"id": "p", "type": "Place", "size": "3"}'})], "id string, type string, properties map<string,string>"))
    assert {(r.id, r.label) for r in nested.nodes.collect()} == {("e", "T"), ("p", "Place")}
    deep = {"id": "n0"}
    for i in range(1, 7):
        deep = {"id": f"n{i}", "in": deep}
    nested = extract.nested_objects(spark.createDataFrame([("e", "T", {"in": json.dumps(deep)})], "id string, type string, properties map<string,string>"))
    assert {r.id for r in nested.nodes.collect()} == {"e", *(f"n{i}" for i in range(7))} and nested.edges.count() == 7
    units = spark.createDataFrame([("c", "u", "text", "a->b", ["q?"], ["Acme"])], "chunk_id string, name string, content string, ontology string, related array<string>, core array<string>")
    got = {(r.from_id, r.label, r.to_id) for r in extract.knowledge_units(units).edges.collect()}
    assert {("b", "isA", "a"), ("q?", "relatedTo", "c_u"), ("acme", "source", "c_u"), ("c_u", "sourceChunk", "c")} == got


def test_outline_of_many_levels(spark):
    titles = [f"Title {i}" for i in range(1, 9)]
    docs = spark.createDataFrame([("d", "\n".join(f"{t}\nbody" for t in titles))], "doc_id string, content string")
    rows = spark.createDataFrame([("d", i, t, i + 1) for i, t in enumerate(titles)], "doc_id string, seq int, title string, level int")
    got = {r.title: r.path for r in split.outline_sections(rows, docs).collect()}
    assert got["Title 8"] == "/".join(titles) and got["Title 1"] == "Title 1"


def test_sections_of_many_pages_leave_in_parts(spark, monkeypatch):
    """A task gives out the sections of a few pages before it reads the next."""
    made, docs = [], spark.createDataFrame([("d", "x")], "id string, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    read.sections(docs, "id", "text", "html")
    page = "<h1>Head</h1><p>" + "word " * 2000 + "</p>"
    pages = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(200)] + [None], "text": [page] * 199 + ["", None]})
    parts = list(made[0](iter([pages])))
    assert max(p.num_rows for p in parts) < 60
    assert [i for p in parts for i in p.column("doc_id").to_pylist()][:199] == [str(i) for i in range(199)]


def test_outline_places_as_column_functions(spark):
    """Titles repeated, inside each other, out of order, absent, empty and null, in texts beyond ASCII."""
    texts = {"a": "ab abc b\U0001f600 abc cd \u4e2d b", "b": "", "c": None, "d": "x"}
    names = ["ab", "abc", "b", "\U0001f600", "cd", "\u4e2d", "zz", "", None, "x"]
    listed = [(d, i, names[(i * step + ord(d)) % 10], i % 3 + 1) for d in texts for step in (1, 3) for i in range(10)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, content string")
    rows = spark.createDataFrame(listed, "doc_id string, seq int, title string, level int")
    want = set()
    for d, text in texts.items():
        kept = []
        for _, title, level in sorted(((s, t, lv) for x, s, t, lv in listed if x == d), key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2])):
            pos = text.find(title) + 1 if text is not None and title is not None else 0
            if pos > (kept[-1][0] if kept else 0):
                kept.append((pos, title, level))
        want |= {(d, pos, t, lv, text[pos - 1 : end - 1]) for (pos, t, lv), end in zip(kept, [k[0] for k in kept[1:]] + [len(text or "") + 1], strict=False)}
    assert {tuple(r) for r in split.outline_sections(rows, docs).select("doc_id", "pos", "title", "level", "content").collect()} == want and want


def test_outline_of_many_titles_takes_one_pass():
    """30,000 titles of a text of 1.5 MB."""
    import time

    titles = [{"title": f"Article {i:06d}", "level": 3} for i in range(30_000)]
    text = "\n".join(f"{x['title']}\n{'body ' * 7}" for x in titles)
    since = time.monotonic()
    cuts = split._cuts(text, titles)
    assert len(cuts) == 30_000 and "".join(c[3] for c in cuts) == text and time.monotonic() - since < 10


def test_bindings(spark):
    a = spark.createDataFrame([("s", "1", "one", "", "")], "alias string, biz_id string, name string, type string, description string")
    b = spark.createDataFrame([("s", "1", "", "T", ""), ("s", "2", "two", "T", "")], a.schema)
    got = {r.biz_id: (r.name, r.type) for r in gr.merge_bindings([a, b]).collect()}
    assert got == {"1": ("one", "T"), "2": ("two", "T")}


def test_nodes_default_to_their_id(spark):
    rows = spark.createDataFrame([(5, None)], "k int, n string")
    assert as_nodes(rows, F.col("k"), "L", F.col("n")).first().name == "5"


def test_every_entity_of_a_chunk_is_linked(spark):
    names = [f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    chunks = spark.createDataFrame([("c", " ".join(reversed(names * 2))), ("d", "Alone"), ("e", "")], "id string, content string")
    facts = extract.co_occurrences(extract.default_entities(chunks)).collect()
    assert sorted((r.chunk_id, r.s, r.p, r.o) for r in facts) == [("c", s, "relates to", o) for s, o in zip(names, names[1:], strict=False)]


def test_names_of_any_number_of_words_are_found(spark):
    long = "International Society for the Study of Very Long Names"
    names = spark.createDataFrame([(long,), ("Customer#000000001",), ("short",), (None,)], "name string")
    texts = spark.createDataFrame([(1, f"about the {long.upper()}, again"), (2, "order of Customer#000000001 now"), (3, "Society for the Study"), (4, None), (5, long)], "query_id int, text string")
    assert sorted(map(tuple, search.names_in_text(texts, names).collect())) == [(1, long), (2, "Customer#000000001"), (5, long)]
    assert search.names_in_text(texts, names.limit(0)).count() == 0
