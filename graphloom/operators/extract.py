"""Extractors (X1-X9): chunks, and what models answered about them, to graphs.

Model answers are columns; where none is given a deterministic default is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.models import model
from graphloom.functions.text import camel_case, hash_id, phrase, reference_list
from graphloom.operators.graph import Graph, as_edges, as_nodes, merge_nodes, properties_of
from graphloom.session import cut


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """Text chunks; the name loses its split suffix and leads the content."""
    text = chunks.where(F.coalesce(F.col("type"), F.lit("TEXT")) == "TEXT") if "type" in chunks.columns else chunks
    name = F.substring_index("name", "_split", 1)
    return as_nodes(text, F.col("id"), "Chunk", name, F.create_map(F.lit("content"), F.concat_ws("\n", name, F.col("content"))))


def plain_chunk_nodes(chunks: DataFrame) -> DataFrame:
    """X9."""
    return as_nodes(chunks, F.col("id"), "Chunk", F.col("name"), properties_of("content"))


def hierarchy(chunks: DataFrame, label: str, parent: str = "parent_id", text: str | None = None) -> Graph:
    """A node per chunk, childOf its parent, sourceChunk to the chunk or table of the same id."""
    kind = F.when(F.col("type") == "TABLE", "Table").otherwise("Chunk") if "type" in chunks.columns else F.lit("Chunk")
    nodes = as_nodes(chunks, F.col("id"), label, F.col("name"), F.create_map(F.lit("content"), F.col(text)) if text else None)
    child = as_edges(chunks.where(F.col(parent).isNotNull()), F.col("id"), label, "childOf", F.col(parent), label)
    source = as_edges(chunks, F.col("id"), label, "sourceChunk", F.col("id"), kind)
    return Graph(nodes, child.unionByName(source))


def summaries(chunks: DataFrame) -> Graph:
    """X3 with the default summary."""
    return hierarchy(chunks.withColumn("_summary", model("summarize")(F.col("content"))), "Summary", text="_summary")


def atomic_queries(chunks: DataFrame, questions: str | None = None) -> Graph:
    """A node per question of a chunk, id ``chunk_question``; null questions give none."""
    asked = F.col(questions) if questions else model("questions")(F.col("content"))
    rows = chunks.select(F.col("id").alias("chunk"), F.explode(asked).alias("question"))
    key = F.concat_ws("_", "chunk", "question")
    return Graph(as_nodes(rows, key, "AtomicQuery", F.col("question")), as_edges(rows, key, "AtomicQuery", "sourceChunk", F.col("chunk"), "Chunk"))


def table_cells(tables: DataFrame) -> DataFrame:
    """(table_id, row, column, header, value) of markdown tables, rows and columns from 0."""
    lines = F.filter(F.split("content", "\n"), lambda x: F.trim(x).startswith("|"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda y: F.trim(y))
    rows = tables.select(F.col("id").alias("table_id"), cells(lines[0]).alias("headers"), F.posexplode(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))).alias("row", "line")).where(F.size("headers") > 0)
    each = rows.select("table_id", "row", "headers", F.posexplode(cells(F.col("line"))).alias("column", "value"))
    return each.select("table_id", "row", "column", F.try_element_at("headers", F.col("column") + 1).alias("header"), "value")


def table_graph(tables: DataFrame, mode: str = "graph") -> Graph:
    """Mode chunk: Table nodes with sourceChunk; mode row_col: a Chunk for each row and column too; mode graph: rows, columns and keywords as nodes."""
    extra = {"beforeText": F.col("before_text"), "afterText": F.col("after_text")} if "before_text" in tables.columns else {}
    nodes = as_nodes(tables, F.col("id"), "Table", F.col("name"), properties_of("content", **extra))
    parent = F.coalesce("parent_id", "id") if "parent_id" in tables.columns else F.col("id")
    source = as_edges(tables, F.col("id"), "Table", "sourceChunk", parent, "Chunk")
    if mode == "chunk":
        return Graph(nodes, source)
    cells = table_cells(tables)
    row_key, column_key = F.concat_ws("#row_", "table_id", F.col("row").cast("string")), F.concat_ws("#column_", "table_id", F.col("column").cast("string"))
    by_row = cells.groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "header", "value"))), lambda x: F.concat_ws(": ", x["header"], x["value"])), "; ").alias("content"))
    by_column = cells.groupBy("table_id", "column").agg(F.first("header").alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]), "; ").alias("content"))
    if mode == "row_col":
        both = by_row.select("table_id", row_key.alias("id"), row_key.alias("name"), "content").unionByName(by_column.select("table_id", column_key.alias("id"), F.coalesce("header", column_key).alias("name"), "content"))
        return Graph(nodes.unionByName(as_nodes(both, F.col("id"), "Chunk", F.col("name"), properties_of("content"))), source.unionByName(as_edges(both, F.col("id"), "Chunk", "sourceTable", F.col("table_id"), "Table")))
    keywords = by_column.where(F.coalesce(F.col("header"), F.lit("")) != "")
    nodes = (
        nodes.unionByName(as_nodes(by_row, row_key, "TableRow", row_key, properties_of("content")))
        .unionByName(as_nodes(by_column, column_key, "TableColumn", F.col("header"), properties_of("content")))
        .unionByName(as_nodes(keywords.select("header").distinct(), phrase(F.col("header")), "TableKeyWord", F.col("header")))
    )
    edges = (
        source.unionByName(as_edges(by_row, F.col("table_id"), "Table", "containRow", row_key, "TableRow"))
        .unionByName(as_edges(by_row, row_key, "TableRow", "partOf", F.col("table_id"), "Table"))
        .unionByName(as_edges(by_column, F.col("table_id"), "Table", "containColumn", column_key, "TableColumn"))
        .unionByName(as_edges(by_column, column_key, "TableColumn", "partOf", F.col("table_id"), "Table"))
        .unionByName(as_edges(keywords, F.col("table_id"), "Table", "keyword", phrase(F.col("header")), "TableKeyWord"))
    )
    return Graph(nodes, edges)


def assembled(entities: DataFrame, facts: DataFrame, official: DataFrame | None = None) -> Graph:
    """``entities(chunk_id, name, type, description)`` and ``facts(chunk_id, s, p, o[, condition])``.

    X6a: ends of facts are the chunk's entities of that normalised name, else Others;
    X6b, X6d: an entity whose official name (``official(name, type, official, seq)``,
    the last wins) differs gets an OfficialName edge; X6c: every node has a source edge.
    """
    found = entities.withColumn("key", phrase(F.col("name"))).where("key <> ''")
    first = found.groupBy("chunk_id", "key").agg(F.min_by(F.struct("name", "type"), F.struct("type", "name")).alias("e"))
    rows = facts.where((F.trim(F.coalesce("s", F.lit(""))) != "") & (F.trim(F.coalesce("p", F.lit(""))) != ""))
    for end in ("s", "o"):
        side = first.select("chunk_id", F.col("key").alias(f"{end}_key"), F.col("e.type").alias(f"{end}_type"))
        rows = rows.withColumn(f"{end}_key", phrase(F.col(end))).join(side, ["chunk_id", f"{end}_key"], "left").withColumn(f"{end}_type", F.coalesce(f"{end}_type", F.lit("Others")))
    sub = properties_of("condition") if "condition" in facts.columns else None
    edges = as_edges(rows, F.col("s_key"), F.col("s_type"), camel_case(F.col("p")), F.col("o_key"), F.col("o_type"), sub)
    ends = rows.select("chunk_id", F.explode(F.array(*[F.struct(F.col(f"{e}_key").alias("key"), F.col(f"{e}_type").alias("type"), F.col(e).alias("name")) for e in ("s", "o")])).alias("x"))
    loose = ends.where("x.type = 'Others'").select("chunk_id", "x.key", "x.type", "x.name")
    known = as_nodes(found, F.col("key"), F.col("type"), F.col("name"), properties_of(desc=F.col("description"), semanticType=F.col("type")))
    nodes = merge_nodes(known.unionByName(as_nodes(loose, F.col("key"), F.col("type"), F.col("name"))).withColumn("seq", F.lit(0)), last=False)
    linked = found.select("chunk_id", "key", "type").unionByName(loose.select("chunk_id", "key", "type")).distinct()
    edges = edges.unionByName(as_edges(linked, F.col("key"), F.col("type"), "source", F.col("chunk_id"), "Chunk"))
    if official is not None:
        named = official.groupBy("name", "type").agg(F.max_by("official", F.struct("seq", "official")).alias("official"))
        pairs = found.join(named, ["name", "type"]).withColumn("official_key", phrase(F.col("official"))).where("official_key <> key").select("key", "type", "official", "official_key").distinct()
        nodes = nodes.unionByName(as_nodes(pairs, F.col("official_key"), F.col("type"), F.col("official")).dropDuplicates(["id", "label"]))
        edges = edges.unionByName(as_edges(pairs, F.col("key"), F.col("type"), "OfficialName", F.col("official_key"), F.col("type")))
    return Graph(nodes, edges)


def default_entities(chunks: DataFrame) -> DataFrame:
    """Entities by the registered model, all of type Others."""
    rows = chunks.select(F.col("id").alias("chunk_id"), F.explode(model("entities")(F.col("content"))).alias("name"))
    return rows.select("chunk_id", "name", F.lit("Others").alias("type"), F.lit(None).cast("string").alias("description"))


def co_occurrences(entities: DataFrame) -> DataFrame:
    """Default facts: neighbouring entities of a chunk, in order of name; linear in the entities."""
    names = entities.where("name IS NOT NULL").select("chunk_id", "name").distinct()
    order = Window.partitionBy("chunk_id").orderBy("name")
    pairs = names.select("chunk_id", F.lag("name").over(order).alias("s"), F.lit("relates to").alias("p"), F.col("name").alias("o"))
    return pairs.where("s IS NOT NULL")


def schema_constrained(entities: DataFrame, events: DataFrame | None, relations: DataFrame | None, known: dict[str, dict[str, str]]) -> Graph:
    """What a schema allows of ``entities`` and ``events(chunk_id, name, type, properties)`` and ``relations(chunk_id, fields)``.

    ``known[type]`` has the target of each property.  Other types and properties go; a
    property whose target is a type of the schema becomes a node for each of its values
    and an edge.  A relation has five fields, subject, its type, predicate, object, its
    type; others are not taken.  Ends that nothing describes are nodes of their type;
    every node has a source edge to its chunks; of equal nodes later values win.
    """
    things = entities if events is None else entities.unionByName(events)
    key = phrase(F.col("name"))
    rows = things.where(F.col("type").isin(list(known))).withColumn("key", key).where("key <> ''")
    allowed = F.create_map(*[x for t, ps in known.items() for x in (F.lit(t), F.array(*[F.lit(p) for p in ps]) if ps else F.array().cast("array<string>"))])
    kept = rows.withColumn("properties", F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & F.array_contains(allowed[F.col("type")], k)))
    targets = [(t, p, o) for t, ps in known.items() for p, o in ps.items() if o in known]
    is_link = lambda p: reduce(lambda a, b: a | b, [(F.col("type") == t) & (p == q) for t, q, _ in targets], F.lit(False))
    links = kept.select("chunk_id", "key", "type", F.explode("properties").alias("p", "v")).where(is_link(F.col("p")))
    aim = reduce(lambda c, x: c.when((F.col("type") == x[0]) & (F.col("p") == x[1]), F.lit(x[2])), targets, F.when(F.lit(False), F.lit("")))
    links = links.withColumn("o_type", aim).select("chunk_id", F.col("key").alias("s"), F.col("type").alias("s_type"), "p", F.explode(reference_list(F.col("v"))).alias("o_name"), "o_type")
    links = links.withColumn("o", phrase(F.col("o_name"))).where("o <> ''")
    if relations is not None:
        f = lambda i: F.col("fields")[i]
        five = relations.where(F.size("fields") == 5).select("chunk_id", phrase(f(0)).alias("s"), f(0).alias("s_name"), f(1).alias("s_type"), camel_case(f(2)).alias("p"), f(3).alias("o_name"), f(4).alias("o_type"), phrase(f(3)).alias("o"))
        five = five.where("s <> '' AND o <> '' AND p <> ''").where(F.col("s_type").isin(list(known)) & F.col("o_type").isin(list(known)))
        links = links.withColumn("s_name", F.lit(None).cast("string")).unionByName(five.select("chunk_id", "s", "s_type", "p", "o_name", "o_type", "o", "s_name"))
    else:
        links = links.withColumn("s_name", F.lit(None).cast("string"))
    plain = kept.withColumn("properties", F.map_filter("properties", lambda k, v: ~is_link(k)))
    described = as_nodes(plain, F.col("key"), F.col("type"), F.col("name"), F.col("properties")).withColumn("seq", F.lit(1))
    loose = links.select(F.explode(F.array(F.struct(F.col("s").alias("key"), F.col("s_type").alias("type"), F.coalesce("s_name", "s").alias("name")), F.struct(F.col("o").alias("key"), F.col("o_type").alias("type"), F.col("o_name").alias("name")))).alias("x"), "chunk_id").select("chunk_id", "x.*")
    nodes = merge_nodes(described.unionByName(as_nodes(loose, F.col("key"), F.col("type"), F.col("name")).withColumn("seq", F.lit(0))), last=True)
    edges = as_edges(links.select("s", "s_type", "p", "o", "o_type").distinct(), F.col("s"), F.col("s_type"), F.col("p"), F.col("o"), F.col("o_type"))
    held = kept.select("chunk_id", "key", "type").unionByName(loose.select("chunk_id", "key", "type")).distinct()
    return Graph(nodes, edges.unionByName(as_edges(held, F.col("key"), F.col("type"), "source", F.col("chunk_id"), "Chunk")))


def nested_objects(entities: DataFrame) -> Graph:
    """``entities(id, type, properties map<string,string>)`` whose JSON-object values become nodes of their own, however deep."""
    nodes, edges, level = None, None, entities.select("id", "type", F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>")).alias("properties"))
    while True:
        plain = F.map_filter("properties", lambda k, v: ~v.rlike(r"^\s*\{"))
        made = as_nodes(level, F.col("id"), F.col("type"), F.col("properties").getItem("name"), plain)
        nodes = made if nodes is None else nodes.unionByName(made)
        inner = level.select("id", "type", F.explode(F.map_filter("properties", lambda k, v: v.rlike(r"^\s*\{"))).alias("prop", "json"))
        inner = inner.select(F.col("id").alias("parent"), F.col("type").alias("parent_type"), "prop", F.from_json("json", "map<string,string>").alias("properties"))
        inner = inner.withColumn("id", F.coalesce(F.col("properties").getItem("id"), F.col("properties").getItem("name"), hash_id(F.to_json("properties")))).withColumn("type", F.coalesce(F.col("properties").getItem("type"), F.lit("Others")))
        link = as_edges(inner, F.col("parent"), F.col("parent_type"), F.col("prop"), F.col("id"), F.col("type"))
        edges = link if edges is None else edges.unionByName(link)
        level = cut(inner.select("id", "type", "properties"))
        if not level.limit(1).count():
            break
    return Graph(merge_nodes(nodes.withColumn("seq", F.lit(0)), last=True), edges)


def triple_units(facts: DataFrame) -> DataFrame:
    """A unit for each triple of ``facts(chunk_id, s, p, o[, condition])``, in the shape that ``knowledge_units`` takes."""
    text = F.concat_ws(" ", "s", "p", "o", *([F.col("condition")] if "condition" in facts.columns else []))
    strings = lambda *c: F.array(*c).cast("array<string>")
    return facts.select("chunk_id", text.alias("name"), text.alias("content"), F.lit(None).cast("string").alias("ontology"), strings().alias("related"), strings("s", "o").alias("core")).distinct()


def knowledge_units(units: DataFrame) -> Graph:
    """``units(chunk_id, name, content, ontology, related array<string>, core array<string>)``.

    The ontology path ``a->b->c`` becomes a chain of SemanticConcept nodes; related
    questions point to the unit; core entities have source edges to it.
    """
    key = F.concat_ws("_", "chunk_id", "name")
    rows = units.withColumn("uid", key)
    parts = F.filter(F.transform(F.split(F.coalesce("ontology", F.lit("")), "->"), lambda x: F.trim(x)), lambda x: x != "")
    chain = rows.select("uid", parts.alias("c")).where(F.size("c") > 0)
    pairs = chain.where(F.size("c") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.col("c")[i].alias("lower"), F.col("c")[i - 1].alias("upper")))).alias("x")).select("x.lower", "x.upper").distinct()
    concepts = chain.select(F.explode("c").alias("name")).distinct()
    related = rows.select("uid", F.explode("related").alias("q"))
    core = rows.select("uid", F.explode("core").alias("e"))
    nodes = as_nodes(rows, F.col("uid"), "KnowledgeUnit", F.col("name"), properties_of("content", "ontology")).unionByName(as_nodes(concepts, F.col("name"), "SemanticConcept")).unionByName(as_nodes(related.select("q").distinct(), F.col("q"), "AtomicQuery"))
    edges = (
        as_edges(pairs, F.col("lower"), "SemanticConcept", "isA", F.col("upper"), "SemanticConcept")
        .unionByName(as_edges(related, F.col("q"), "AtomicQuery", "relatedTo", F.col("uid"), "KnowledgeUnit"))
        .unionByName(as_edges(core, phrase(F.col("e")), "Others", "source", F.col("uid"), "KnowledgeUnit"))
        .unionByName(as_edges(rows, F.col("uid"), "KnowledgeUnit", "sourceChunk", F.col("chunk_id"), "Chunk"))
    )
    return Graph(nodes, edges)
