"""Retrieval flows, presets and registries (C1-C9, C11, 2.19, 2.21).

A flow text ``a,b->c;d`` runs a and b, feeds both to c, and runs d beside them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import extract, retrieve, search, split
from graphloom.operators.fusion import by_priority, rrf, top
from graphloom.operators.graph import Graph, as_nodes
from graphloom.plans.schema import Catalog
from graphloom.plans.schema import parse as parse_schema

Component = Callable[[list[DataFrame]], DataFrame]


def parse_flow(text: str) -> tuple[list[str], dict[str, list[str]]]:
    """Components in an order that runs, and the inputs of each."""
    inputs: dict[str, list[str]] = {}
    for chain in text.split(";"):
        stages = [[x.strip() for x in stage.split(",") if x.strip()] for stage in chain.split("->") if stage.strip()]
        for i, stage in enumerate(stages):
            for name in stage:
                have = inputs.setdefault(name, [])
                have += [x for x in (stages[i - 1] if i else []) if x not in have]
    order: list[str] = []
    while len(order) < len(inputs):
        ready = [n for n, needs in inputs.items() if n not in order and all(x in order for x in needs)]
        if not ready:
            raise ValueError("the flow has a cycle")
        order += ready
    return order, inputs


def run_flow(text: str, components: dict[str, Component], breaks: dict[str, Callable[[DataFrame], bool]] | None = None) -> DataFrame:
    """One lazy plan; hits of the components that feed no other are united.

    ``breaks`` (C5): after a component whose test of its hits is true, the components
    that come later in the order do not run; tests are bounded looks at the hits.
    """
    order, inputs = parse_flow(text)
    made: dict[str, DataFrame] = {}
    for name in order:
        made[name] = components[name]([made[x] for x in inputs[name]])
        if breaks and name in breaks and breaks[name](made[name]):
            order = list(made)
            inputs = {n: inputs[n] for n in order}
            break
    fed = {x for needs in inputs.values() for x in needs}
    return reduce(DataFrame.unionByName, [made[n] for n in order if n not in fed])


def hybrid(lists: list[DataFrame], k: int = 10, priorities: list[list[DataFrame]] | None = None) -> DataFrame:
    """Rank fusion of retrievers' hits; later priority groups only for unanswered queries."""
    fused = top(rrf(reduce(DataFrame.unionByName, lists)), k)
    return by_priority([fused, *[top(rrf(reduce(DataFrame.unionByName, g)), k) for g in priorities]]) if priorities else fused


def component_chain(start, *stages):
    """``a >> [b, c] >> d``: lists run side by side on the same input and are united."""
    out = start
    for stage in stages:
        out = reduce(DataFrame.unionByName, [s(out) for s in stage]) if isinstance(stage, list) else stage(out)
    return out


@dataclass
class Index:
    """C11: an index bundles how it is built from chunks, how chunks are found by it, and the schema of what it makes.

    ``retrieve(graph, queries, k)`` gives (query_id, id, score, rank) of chunks for
    ``queries(query_id, text)``; ``schema`` is a text of the schema language.
    """

    name: str
    build: Callable[[DataFrame], Graph]
    needs_model: bool
    about: str
    retrieve: Callable[[Graph, DataFrame, int], DataFrame] | None = None
    schema: str = ""


INDEXES: dict[str, Index] = {}


def register_index(index: Index) -> Index:
    INDEXES[index.name] = index
    return index


def _by_vector(nodes: DataFrame, text: Column, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of nodes by the embedding of a text of theirs; each distinct text is embedded once."""
    held = search.vectorized(nodes.select("id", text.alias("text")), "text", "vec").where("vec IS NOT NULL").select("id", "vec")
    asked = search.vectorized(queries.select("query_id", "text"), "text", "qvec").where("qvec IS NOT NULL").select("query_id", "qvec")
    return search.top_vectors_batch(search.cut(held), asked, k).select("query_id", "id", "score")


def _content_chunks(label: str):
    """Chunks by the vectors of their contents and by full text, ranks fused."""

    def find(graph: Graph, queries: DataFrame, k: int) -> DataFrame:
        nodes = graph.nodes.where(F.col("label") == label)
        content = F.col("properties").getItem("content")
        words = search.bm25(*search.inverted_index(nodes.select("id", content.alias("text"))), queries, k)
        lists = [_by_vector(nodes, content, queries, k).withColumn("list_id", F.lit(0)), words.select("query_id", "id", "score").withColumn("list_id", F.lit(1))]
        return top(rrf(reduce(DataFrame.unionByName, lists)), k)

    return find


def _through(label: str, text: Callable[[], Column]):
    """Chunks that nodes of a label come from, the nodes found by vector; a chunk has the best score of its nodes."""

    def find(graph: Graph, queries: DataFrame, k: int) -> DataFrame:
        hits = _by_vector(graph.nodes.where(F.col("label") == label), text(), queries, k)
        source = graph.edges.where((F.col("from_type") == label) & (F.col("label") == "sourceChunk")).select(F.col("from_id").alias("id"), F.col("to_id").alias("chunk_id"))
        return top(hits.join(source, "id").groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.max("score").alias("score")), k)

    return find


def _entity_chunks(graph: Graph, queries: DataFrame, k: int) -> DataFrame:
    """Chunks near a question's entities: names in the text are linked, then PageRank is pushed from them."""
    names = graph.nodes.where(F.col("label") != "Chunk")
    found = search.names_in_text(queries, names.select("name").distinct(), least=2)
    linked = found.join(names.select("name", "id", "label"), "name").select("query_id", "id", "label")
    chunks = graph.edges.where("label = 'source'").select(F.col("to_id").alias("id")).distinct()
    held = Graph(graph.nodes.unionByName(as_nodes(chunks, F.col("id"), "Chunk")), graph.edges)
    none = queries.limit(0).select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return retrieve.ppr_chunks(held, linked, none, k, least=1e-3)


CONTENT = """{0}({0}): EntityType
    properties:
        content(content): Text
            index: TextAndVector
"""
NAMED = """{0}({0}): EntityType
    properties:
        name(name): Text
            index: TextAndVector
    relations:
        sourceChunk(source chunk): Chunk
"""

register_index(Index("chunk", lambda c: Graph(extract.chunk_nodes(c), Graph.empty(c.sparkSession).edges), False, "text pieces", _content_chunks("Chunk"), CONTENT.format("Chunk")))
register_index(Index("table", lambda c: extract.table_graph(c.where("type = 'TABLE'"), "chunk"), False, "tables with their surroundings", _content_chunks("Table"), CONTENT.format("Table")))
register_index(Index("outline", lambda c: extract.hierarchy(c, "Outline"), False, "section titles", _through("Outline", lambda: F.col("name")), NAMED.format("Outline")))
register_index(Index("summary", extract.summaries, True, "summaries of sections", _through("Summary", lambda: F.col("properties").getItem("content")), CONTENT.format("Summary")))
register_index(Index("atomic_query", extract.atomic_queries, True, "questions that a chunk answers", _through("AtomicQuery", lambda: F.col("name")), NAMED.format("AtomicQuery")))
register_index(Index("graph", lambda c: extract.assembled(e := extract.default_entities(c), extract.co_occurrences(e)), True, "entities and their relations", _entity_chunks, NAMED.format("Others")))


class IndexManager:
    """Several indexes as one: built together, searched together by rank fusion, their schema one catalog."""

    def __init__(self, names: tuple[str, ...]):
        unknown = [n for n in names if n not in INDEXES]
        if unknown:
            raise KeyError(f"no indexes {unknown}; there are {sorted(INDEXES)}")
        self.indexes = [INDEXES[n] for n in names]

    def schema(self, namespace: str = "Texts") -> Catalog:
        return parse_schema(f"namespace {namespace}\n" + "".join(dict.fromkeys([INDEXES["chunk"].schema, *(i.schema for i in self.indexes)])))

    def build(self, chunks: DataFrame) -> Graph:
        return reduce(Graph.plus, [i.build(chunks) for i in self.indexes])

    def retrieve(self, graph: Graph, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) of chunks."""
        return hybrid([i.retrieve(graph, queries, k).select("query_id", "id", "score").withColumn("list_id", F.lit(i.name)) for i in self.indexes if i.retrieve], k)


def build_unstructured(docs: DataFrame, indexes: tuple[str, ...] = ("chunk",), size: int = 500, window: int = 100) -> Graph:
    """The stock chain for texts: split, index, align."""
    chunks = split.by_sentences(docs, size, window)
    return reduce(Graph.plus, [INDEXES[x].build(chunks) for x in indexes]).aligned()


def build_structured(graphs: list[Graph], store: Graph) -> Graph:
    """The stock chain for records: mapped graphs upserted into a store."""
    return reduce(Graph.upsert, graphs, store)


def inject(spark: SparkSession, nodes: DataFrame, edges: DataFrame, store: Graph) -> Graph:
    """The stock chain for external graphs."""
    return store.upsert(Graph(nodes, edges))
