"""Retrievers (T1-T12) and entity linking (E1-E5): queries to ranked chunks or bindings.

Similarities of vectors come as ``hits(query_id, id, score)`` from
``search.top_vectors_batch``; thresholds are arguments, since they depend on the
backend's scale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.models import model
from graphloom.functions.vectors import cosine
from graphloom.operators import search
from graphloom.operators.fusion import top
from graphloom.operators.graph import Graph


def best_of(fields: list[DataFrame], least: float) -> DataFrame:
    """The best score of an item over the searched fields, if it reaches ``least``."""
    rows = reduce(DataFrame.unionByName, [f.select("query_id", "id", "score") for f in fields])
    return rows.where(F.col("score") >= least).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def vector_chunks(chunks: DataFrame, queries: DataFrame, k: int, least: float = 0.85) -> DataFrame:
    """Content vectors (k) and name vectors (k / 2, at least 1) of ``chunks(id, content_vec, name_vec)``."""
    content = search.top_vectors_batch(chunks.select("id", F.col("content_vec").alias("vec")), queries, k)
    name = search.top_vectors_batch(chunks.select("id", F.col("name_vec").alias("vec")), queries, max(1, k // 2))
    return top(best_of([content, name], least), k)


def content_chunks(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """T1b, Q13."""
    return search.top_vectors_batch(chunks.select("id", F.col("content_vec").alias("vec")), queries, k)


def text_chunks(index: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """T2."""
    return search.bm25(index, stats, queries, k)


def linked_entities(named: DataFrame, fallback: DataFrame | None = None, described: DataFrame | None = None, excluded: list[str] | None = None, least: float = 0.7, k: int = 1) -> DataFrame:
    """``named(query_id, id, label, score)`` by name vectors, with description hits; queries without any take the fallback's."""
    rows = named if described is None else named.unionByName(described)
    if fallback is not None:
        rows = rows.unionByName(fallback.join(rows.select("query_id").distinct(), "query_id", "left_anti"))
    if excluded:
        rows = rows.where(~F.col("label").isin(excluded))
    best = rows.where(F.col("score") >= least).groupBy("query_id", "id", "label").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "label")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def link_mentions(graph: Graph, mentions: DataFrame, k_of: dict[str, int] | None = None, k: int = 1, least: float = 0.7, excluded: list[str] | None = None, described: str | None = None) -> DataFrame:
    """(query_id, mention, id, label, score, rank) of ``mentions(query_id, mention, type)``, from their text.

    An entity scores 1 by its name in any case, else the cosine of the embedded names or,
    with the property ``described``, of its description; the score is adjusted to the
    wanted type (E2; a null type is none); of equal scores equal names come first.  A mention gets ``k_of`` its type, or ``k``.
    Equal names are found by a join.  Only mentions that have too few of the wanted type are
    compared by vectors, with each distinct text, embedded once.
    """
    nodes = graph.nodes.where(~F.col("label").isin(excluded)) if excluded else graph.nodes
    most = F.lit(k)
    for kind, n in (k_of or {}).items():
        most = F.when(F.col("wanted") == kind, n).otherwise(most)
    asked_for = mentions.select("query_id", "mention", F.col("type").alias("wanted")).distinct()
    wanted = search.cut(asked_for.select("mention", "wanted").distinct().withColumn("most", most))
    named = nodes.select("id", "label", F.col("name").alias("text"))
    texts = named if described is None else named.unionByName(nodes.select("id", "label", F.col("properties").getItem(described).alias("text")).where("text IS NOT NULL"))
    exact = wanted.select("mention").distinct().join(named.select(F.lower("text").alias("low"), "text").distinct(), F.lower("mention") == F.col("low")).select("mention", "text", F.lit(1.0).alias("score"))
    same = search.cut(exact.join(texts, "text").groupBy("mention", "id", "label").agg(F.max("score").alias("score")).withColumn("same", F.lit(1)))
    # nothing comes before equal names of the wanted type: who has enough of them needs no vectors
    held = same.groupBy("mention", "label").agg(F.count(F.lit(1)).alias("n"))
    enough = wanted.join(held, "mention").where("wanted IS NULL OR wanted = label").groupBy("mention", "wanted", "most").agg(F.sum("n").alias("n")).where("n >= most").select(F.col("mention").alias("m"), F.col("wanted").alias("w"))
    rest = search.cut(wanted.join(enough, (F.col("mention") == F.col("m")) & F.col("wanted").eqNullSafe(F.col("w")), "left_anti").select("mention").distinct())
    hits = same
    if rest.limit(1).count():
        asked = search.vectorized(rest, "mention", "qvec").where("qvec IS NOT NULL").select(F.col("mention").alias("query_id"), "qvec")
        once = search.vectorized(texts.select("text").distinct(), "text", "vec").where("vec IS NOT NULL").select(F.col("text").alias("id"), "vec")
        # several entities may share a text, so as many texts suffice
        near = search.top_vectors_batch(search.cut(once), asked, max([k, *(k_of or {}).values()])).select(F.col("query_id").alias("mention"), F.col("id").alias("text"), "score")
        found = near.join(texts, "text").select("mention", "id", "label", "score", F.lit(0).alias("same"))
        hits = same.unionByName(found).groupBy("mention", "id", "label").agg(F.max("score").alias("score"), F.max("same").alias("same"))
    rows = wanted.join(hits, "mention")
    embed = model("embed")
    kinds = search.cut(rows.where("wanted IS NOT NULL AND wanted <> label").select("wanted", "label").distinct()).withColumn("similar", cosine(embed(F.col("wanted")), embed(F.col("label"))))
    rows = rows.join(kinds, ["wanted", "label"], "left").withColumn("score", type_adjusted(F.col("score"), F.col("label"), F.col("wanted"), F.coalesce("similar", F.lit(0.0)))).where(F.col("score") >= least)
    order = Window.partitionBy("mention", "wanted").orderBy(F.desc(F.round("score", 9)), F.desc("same"), "id", "label")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("most")).select(F.col("mention").alias("m"), F.col("wanted").alias("w"), "id", "label", "score", "rank")
    # mentions are ranked once, whoever asks for them
    return asked_for.join(best, (F.col("mention") == F.col("m")) & F.col("wanted").eqNullSafe(F.col("w"))).select("query_id", "mention", "id", "label", "score", "rank")


def type_adjusted(score: Column, label: Column, wanted: Column, similarity: Column) -> Column:
    """Full score for the wanted type, 0.3 of it without one, else by the types' similarity (0.3 below 0.6)."""
    return score * F.when(label == wanted, 1.0).when(wanted.isNull(), 0.3).otherwise(F.when(similarity < 0.6, 0.3).otherwise(similarity))


def standard_type(names: DataFrame, concepts: DataFrame, least: float = 0.9) -> DataFrame:
    """The best concept of each ``names(name, vec)``, or Entity with score 1."""
    found = search.top_vectors_batch(concepts.select(F.col("name").alias("id"), "vec"), names.select(F.col("name").alias("query_id"), F.col("vec").alias("qvec")), 1).where(F.col("score") >= least)
    rows = names.select("name").join(found.select(F.col("query_id").alias("name"), F.col("id").alias("concept"), "score"), "name", "left")
    return rows.select("name", F.coalesce("concept", F.lit("Entity")).alias("type"), F.coalesce("score", F.lit(1.0)).alias("score"))


def shown_name(name: Column, official: Column, category: Column) -> Column:
    """The official name unless the category is works, person or other."""
    return F.when(F.lower(category).isin("works", "person", "other", "others"), name).otherwise(F.coalesce(official, name))


def self_cognition(queries: DataFrame) -> DataFrame:
    """E5: routes questions about the system past retrieval."""
    return queries.withColumn("self_question", model("is_self_question")(F.col("text")))


def ppr_chunks(graph: Graph, linked: DataFrame, texts: DataFrame, k: int, damping: float = 0.85, least: float = 1e-6) -> DataFrame:
    """T4: PageRank from each query's linked entities; the last of the k hits gives way to the best text hit if that is absent.

    ``linked(query_id, id, label)``, or of all labels of an id without ``label``;
    ``texts(query_id, id, score, rank)``.  Residuals are pushed from each query's
    entities (``search.pushed_pagerank``), so only their neighbourhoods are visited.
    """
    key = lambda i, label: F.struct(F.col(i).alias("id"), F.col(label).alias("label")).cast("struct<id:string,label:string>")
    edges = graph.edges.select(key("from_id", "from_type").alias("src"), key("to_id", "to_type").alias("dst"))
    if "label" not in linked.columns:
        linked = linked.join(graph.nodes.select("id", "label").distinct(), "id")
    ranks = search.pushed_pagerank(edges, linked.select("query_id", key("id", "label").alias("id")), damping, least)
    hits = top(ranks.where(F.col("id.label") == "Chunk").select("query_id", F.col("id.id").alias("id"), "score"), k)
    return with_text_hit(hits, texts, k)


def with_text_hit(hits: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The best text hit of a query takes the k-th place if it is not among the hits."""
    best = texts.where("rank = 1").select("query_id", "id", "score")
    missing = best.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("rank", F.lit(k))
    kept = hits.join(missing.select("query_id", "rank"), ["query_id", "rank"], "left_anti")
    return kept.select("query_id", "id", "score", "rank").unionByName(missing)


def hierarchical(graph: Graph, hits: DataFrame, label: str, k: int | None = None) -> DataFrame:
    """The hit summaries or outlines, their children, and the chunks these come from."""
    child = graph.edges.where((F.col("label") == "childOf") & (F.col("to_type") == label)).select(F.col("to_id").alias("id"), F.col("from_id").alias("child"))
    own = hits.select("query_id", "id")
    all_ = own.unionByName(own.join(child, "id").select("query_id", F.col("child").alias("id"))).distinct()
    source = graph.edges.where((F.col("label") == "sourceChunk") & (F.col("from_type") == label)).select(F.col("from_id").alias("id"), F.col("to_id").alias("chunk_id"))
    found = all_.join(source, "id").select("query_id", "chunk_id").distinct()
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tables(rows: DataFrame, searches: list[DataFrame], k: int, least: float = 0.8) -> DataFrame:
    """The best of name, content, beforeText and afterText hits; the content comes with its surroundings."""
    hits = top(best_of(searches, least), k)
    return hits.join(rows.select("id", F.concat_ws("\n", "before_text", "content", "after_text").alias("content")), "id")


def atomic_query_chunks(graph: Graph, hits: DataFrame, contents: DataFrame, least: float = 0.85) -> DataFrame:
    """Questions reaching ``least``, best score each, to their source in the order Chunk, Table, Summary, then the content hits."""
    good = best_of([hits], least)
    source = graph.edges.where((F.col("label") == "sourceChunk") & (F.col("from_type") == "AtomicQuery"))
    place = F.when(F.col("to_type") == "Chunk", 1).when(F.col("to_type") == "Table", 2).when(F.col("to_type") == "Summary", 3)
    first = source.withColumn("place", place).where("place IS NOT NULL").groupBy(F.col("from_id").alias("id")).agg(F.min_by("to_id", F.struct("place", "to_id")).alias("chunk_id"))
    found = good.join(first, "id").groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.max("score").alias("score"))
    rest = contents.select("query_id", "id", "score").join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return found.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)))


def rewritten_hits(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): ``rows(id, vec)`` by each question of ``queries(query_id, text)`` and by its other wordings, the best score of each."""
    asked = queries.select("query_id", F.explode(F.array_distinct(F.concat(F.array("text"), model("rewrite")(F.col("text"))))).alias("text"))
    vectors = search.vectorized(asked.select("text").distinct(), "text", "qvec").where("qvec IS NOT NULL").select(F.col("text").alias("query_id"), "qvec")
    found = search.top_vectors_batch(search.cut(rows), vectors, k).select(F.col("query_id").alias("text"), "id", "score")
    return asked.join(found, "text").groupBy("query_id", "id").agg(F.max("score").alias("score"))


def triple_neighbours(graph: Graph, queries: DataFrame, k: int, least: float = 0.7) -> DataFrame:
    """(query_id, s_id, s_type, rel, o_id, o_type, score): edges whose triple text is near a text of ``queries(query_id, text)``."""
    names = graph.nodes.select("id", "label", "name")
    edges = graph.edges.select("from_id", "from_type", F.col("label").alias("rel"), "to_id", "to_type").distinct()
    for side in ("from", "to"):
        edges = edges.join(names.select(F.col("id").alias(f"{side}_id"), F.col("label").alias(f"{side}_type"), F.col("name").alias(f"{side}_name")), [f"{side}_id", f"{side}_type"], "left")
    edges = edges.withColumn("text", triple_text(F.coalesce("from_name", "from_id"), F.col("rel"), F.coalesce("to_name", "to_id")))
    once = search.vectorized(edges.select("text").distinct(), "text", "vec").select(F.col("text").alias("id"), "vec")
    asked = search.vectorized(queries.select("query_id", "text"), "text", "qvec").where("qvec IS NOT NULL").select("query_id", "qvec")
    near = search.top_vectors_batch(search.cut(once), asked, k).where(F.col("score") >= least).select("query_id", F.col("id").alias("text"), "score")
    return near.join(edges, "text").select("query_id", F.col("from_id").alias("s_id"), F.col("from_type").alias("s_type"), "rel", F.col("to_id").alias("o_id"), F.col("to_type").alias("o_type"), "score")


# paths (G1, G2, G4, G6)


def exact_one_hop(graph: Graph, subjects: DataFrame | None, labels: list[str] | None, predicates: list[str], objects: list[str] | None = None, object_name: str | None = None) -> DataFrame:
    """G1: bound subjects and allowed labels, predicate equal to one of some, attributes included."""
    edges = graph.edges.where(F.col("label").isin(predicates))
    rows = edges.select(F.col("from_id").alias("s_id"), F.col("from_type").alias("s_type"), F.col("label").alias("p"), F.col("to_id").alias("o_id"), F.col("to_type").alias("o_type"))
    names = graph.nodes.select(F.col("id").alias("o_id"), F.col("label").alias("o_type"), F.col("name").alias("o_name"))
    rows = rows.join(names, ["o_id", "o_type"], "left").select("s_id", "s_type", "p", "o_id", "o_type", "o_name")
    props = graph.attributes().where(F.col("rel").isin(predicates)).select("s_id", "s_type", F.col("rel").alias("p"), F.col("o_name").alias("o_id"), "o_type", "o_name")
    rows = rows.unionByName(props)
    if subjects is not None:
        rows = rows.join(subjects.select(F.col("id").alias("s_id")).distinct(), "s_id", "left_semi")
    if labels:
        rows = rows.where(F.col("s_type").isin(labels))
    if objects:
        rows = rows.where(F.col("o_type").isin(objects))
    return rows.where(F.col("o_name") == object_name) if object_name is not None else rows


def fuzzy_one_hop(graph: Graph, starts: DataFrame, question: str, k: int = 15, least: float = 0.3) -> DataFrame:
    """Triples and attributes around the starts as text, the most similar to the question first."""
    hops = graph.one_hop(starts).select("s_id", "s_type", "rel", "o_id", "o_type", F.coalesce("o_name", "o_id").alias("o_name"))
    near = graph.attributes().join(starts.select(F.col("id").alias("s_id"), F.col("label").alias("s_type")), ["s_id", "s_type"], "left_semi")
    rows = hops.unionByName(near.select("s_id", "s_type", "rel", F.col("o_name").alias("o_id"), "o_type", "o_name"))
    rows = rows.where(~F.col("rel").startswith("_") & ~F.col("rel").isin("id", "source", "similar"))
    names = graph.nodes.select(F.col("id").alias("s_id"), F.col("label").alias("s_type"), F.col("name").alias("s_name"))
    rows = rows.join(names, ["s_id", "s_type"], "left").withColumn("text", triple_text(F.coalesce("s_name", "s_id"), F.col("rel"), F.col("o_name")))
    made = search.with_embedded(search.vectorized(rows, "text", "_vec"), question, "_query")
    scored = made.withColumn("score", cosine(F.col("_vec"), F.col("_query"))).where(F.col("score") >= least).select(*rows.columns, "score")
    return scored.orderBy(F.desc("score"), "text").limit(k)


def triple_text(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(" ", s, p, o), F.lit(")"))


def fuzzy_chunks(graph: Graph, starts: DataFrame, question: str, texts: DataFrame, k: int) -> DataFrame:
    """Ends of fuzzy triples start the PageRank of T4."""
    found = fuzzy_one_hop(graph, starts, question)
    ends = found.select(F.explode(F.array(F.struct(F.col("s_id").alias("id"), F.col("s_type").alias("label")), F.struct(F.col("o_id").alias("id"), F.col("o_type").alias("label")))).alias("x"))
    ends = ends.select("x.id", "x.label").distinct().withColumn("query_id", F.lit(question))
    return ppr_chunks(graph, ends, texts, k)


def unit_neighbours(graph: Graph, mentions: DataFrame, triples: DataFrame, least: float = 0.7) -> DataFrame:
    """Knowledge units and questions whose vectors are near, and triple texts of subject and object mentions.

    ``mentions(query_id, id, label, score)`` are vector hits; ``triples(query_id, s, o)``
    name mention pairs of a query, matched to edges by an equi-join on both ends.
    """
    near = mentions.where(F.col("label").isin("AtomicQuery", "KnowledgeUnit") & (F.col("score") > least)).select("query_id", "id")
    ends = graph.edges.select(F.col("from_id").alias("s"), F.col("to_id").alias("o"))
    hit = triples.join(ends, ["s", "o"]).select("query_id", F.explode(F.array("s", "o")).alias("id"))
    return near.unionByName(hit).distinct()
