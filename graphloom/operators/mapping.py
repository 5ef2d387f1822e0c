"""Mappings (M1-M7): records to graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import rebased_date, reference_list
from graphloom.operators.graph import Graph, as_edges, as_nodes, empty_map, properties_of

__all__ = ["hypernyms", "map_records", "map_relations", "map_spo", "rebased_date", "top_link"]


def map_records(
    rows: DataFrame,
    label: str,
    fields: dict[str, str | list[str]],
    references: dict[str, str] | None = None,
    links: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    fuse: Callable[[DataFrame], DataFrame] | None = None,
    allowed: set[str] | None = None,
) -> Graph:
    """M1, M5, M7: ``fields`` maps target properties to source columns (of several the last non-null wins).

    ``references`` names the properties whose comma lists become edges, with the type
    they point to; the node keeps them as properties too.  A link operator gets
    ``(s_id, value)`` rows and returns ``(s_id, target)``; a fuse operator gets the
    nodes.  A missing name is the id and the other way round.
    """
    if allowed is not None and (unknown := set(fields) - allowed - {"id", "name"}):
        raise ValueError(f"{label} has no properties {sorted(unknown)}")
    picked = [F.coalesce(*[F.col(c).cast("string") for c in reversed(source)]).alias(target) if isinstance(source, list) else F.col(source).cast("string").alias(target) for target, source in fields.items()]
    got = rows.select(*picked)
    for missing, other in (("id", "name"), ("name", "id")):
        if missing not in got.columns:
            got = got.withColumn(missing, F.col(other))
    got = got.withColumns({"id": F.coalesce("id", "name"), "name": F.coalesce("name", "id")})
    nodes = as_nodes(got, F.col("id"), label, F.col("name"), properties_of(*[c for c in got.columns if c not in ("id", "name")]) if len(got.columns) > 2 else empty_map())
    edges = None
    for prop, target in (references or {}).items():
        values = got.where(F.col(prop).isNotNull()).select(F.col("id").alias("s_id"), F.explode(reference_list(F.col(prop))).alias("value"))
        linked = links[prop](values).select("s_id", F.col("target").alias("value")) if links and prop in links else values
        made = as_edges(linked, F.col("s_id"), label, prop, F.col("value"), target)
        edges = made if edges is None else edges.unionByName(made)
    if fuse:
        nodes = fuse(nodes)
    return Graph(nodes, edges if edges is not None else Graph.empty(rows.sparkSession).edges)


def top_link(values: DataFrame, candidates: DataFrame, on: Column | None = None) -> DataFrame:
    """For each (s_id, value) the best candidate (id, name): the smallest id whose name equals the value."""
    best = candidates.groupBy("name").agg(F.min("id").alias("target"))
    return values.join(best, values.value == best.name if on is None else on).select("s_id", "value", "target")


def hypernyms(paths: DataFrame, column: str, label: str = "Concept", relation: str = "isA") -> Graph:
    """M2: ``a-b-c`` to nodes a, a-b, a-b-c (named by the last part) and edges child to parent."""
    parts = F.split(F.col(column), "-")
    ids = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    each = paths.where(F.col(column).isNotNull()).select(F.explode(ids).alias("cid")).distinct()
    nodes = as_nodes(each, F.col("cid"), label, F.element_at(F.split("cid", "-"), -1))
    child = each.where(F.contains(F.col("cid"), F.lit("-")))
    edges = as_edges(child, F.col("cid"), label, relation, F.regexp_replace("cid", "-[^-]*$", ""), label)
    return Graph(nodes, edges)


def map_relations(rows: DataFrame, source_type: str, relation: str, target_type: str, source: str = "srcId", target: str = "dstId", properties: list[str] | None = None) -> DataFrame:
    """M3: one edge a row; without a list all other columns are sub-properties."""
    rest = properties if properties is not None else [c for c in rows.columns if c not in (source, target)]
    return as_edges(rows, F.col(source), source_type, relation, F.col(target), target_type, properties_of(*rest) if rest else empty_map())


def map_spo(rows: DataFrame, subject: str, predicate: str, obj: str, subject_type: str | None = None, object_type: str | None = None, json: str | None = None, properties: list[str] | None = None) -> Graph:
    """M4: two nodes and an edge a row; empty types are Others; sub-properties from a JSON column or from columns, not both."""
    if json and properties:
        raise ValueError("sub-properties come from a JSON column or from columns, not both")
    kind = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("Others")) if c else F.lit("Others")
    sub = F.coalesce(F.from_json(json, "map<string,string>"), empty_map()) if json else properties_of(*properties) if properties else empty_map()
    s, o = F.col(subject).cast("string"), F.col(obj).cast("string")
    nodes = as_nodes(rows, s, kind(subject_type)).unionByName(as_nodes(rows, o, kind(object_type)))
    return Graph(nodes.dropDuplicates(["id", "label"]), as_edges(rows, s, kind(subject_type), F.col(predicate), o, kind(object_type), sub))


def nearest_by(values: DataFrame, candidates: DataFrame, score: Column, least: float) -> DataFrame:
    """A link operator over scored candidates that share a blocking key ``block``."""
    rows = values.join(candidates, "block").withColumn("score", score).where(F.col("score") >= least)
    order = Window.partitionBy("s_id", "value").orderBy(F.desc("score"), "id")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("s_id", "value", F.col("id").alias("target"), "score")
