"""The engine as SQL (Q8, 2.19): views over a graph and its indexes, and functions, for queries that are text only.

Views: ``<prefix>nodes``, ``<prefix>edges``, and for each label that a schema types or a
caller names one view of its nodes with a column a property.  Filters on labels and
columns reach the stored files, since views are plans like any other.

Functions are SQL functions of the session, so they stay inside generated code:
``graph_cosine``, ``graph_dot``, ``words_of``, ``token_jaccard`` and ``rank_score``, and
tables ``<prefix>one_hop(id, label)`` and ``<prefix>attributes(id, label)``.  Spark takes such
functions in select lists and conditions, not in ORDER BY: name the column first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.indexes import TextIndex, VectorIndex

#: Scalar functions: arguments, result and body.
SCALARS = {
    "graph_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "graph_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "graph_dot(a, b) / nullif(sqrt(graph_dot(a, a)) * sqrt(graph_dot(b, b)), 0D)"),
    "words_of": ("t STRING", "ARRAY<STRING>", r"filter(split(lower(t), '[^\\p{L}\\p{N}]+'), x -> x <> '')"),
    "token_jaccard": ("a STRING, b STRING", "DOUBLE", "size(array_intersect(words_of(a), words_of(b))) / nullif(size(array_union(words_of(a), words_of(b))), 0)"),
    "rank_score": ("place INT", "DOUBLE", "1D / place"),
}


def plain(name: str) -> str:
    """A label or property as an identifier."""
    return re.sub(r"\W+", "_", name).strip("_").lower() or "x"


def register(spark: SparkSession, graph: Graph, prefix: str = "graph_", properties: dict[str, dict[str, str]] | None = None) -> list[str]:
    """Makes views and functions; ``properties[label][property]`` is a type, and gives ``label`` a view with these columns."""
    names = []

    def view(name: str, rows: DataFrame) -> None:
        rows.createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")

    view("nodes", graph.nodes)
    view("edges", graph.edges)
    for label, columns in (properties or {}).items():
        typed = [F.col("properties").getItem(p).try_cast(kind).alias(plain(p)) for p, kind in columns.items()]
        view(plain(label), graph.nodes.where(F.col("label") == label).select("id", "name", *typed))
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}one_hop(i STRING, l STRING) RETURNS TABLE(direction STRING, relation STRING, id STRING, label STRING) RETURN
        SELECT 'out', e.label, e.to_id, e.to_type FROM {prefix}edges e WHERE e.from_id = {prefix}one_hop.i AND e.from_type = {prefix}one_hop.l
        UNION ALL SELECT 'in', e.label, e.from_id, e.from_type FROM {prefix}edges e WHERE e.to_id = {prefix}one_hop.i AND e.to_type = {prefix}one_hop.l"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}attributes(i STRING, l STRING) RETURNS TABLE(property STRING, value STRING) RETURN
        SELECT p.key, p.value FROM {prefix}nodes n, LATERAL explode(n.properties) p WHERE n.id = {prefix}attributes.i AND n.label = {prefix}attributes.l"""
    )
    return names


def register_text_index(spark: SparkSession, index: TextIndex, name: str) -> None:
    """Views ``<name>_postings(term, id, tf, length)`` and ``<name>_documents(id, length)`` of an index's live rows."""
    state = index.state()
    index._postings(index._segments(state, "blocks"), state).select("term", "id", "tf", "length").createOrReplaceTempView(f"{name}_postings")
    index.live(index._segments(state, "docs"), state).select("id", "length").createOrReplaceTempView(f"{name}_documents")


def register_vector_index(spark: SparkSession, index: VectorIndex, name: str) -> None:
    """View ``<name>(id, vec, cell)`` of an index's live rows; a filter on ``cell`` reads that folder only."""
    state = index.state()
    index.live(index._segments(state, "cells"), state).select("id", "vec", "cell").createOrReplaceTempView(name)
