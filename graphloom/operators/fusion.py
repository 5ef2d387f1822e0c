"""Rank fusion and re-ranking (U1-U9) of ``hits(query_id, list_id, id, score)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.models import model
from graphloom.functions.vectors import cosine, min_max, reciprocal


def ranked(hits: DataFrame) -> DataFrame:
    """Place within each list, from 1; ties by id."""
    order = Window.partitionBy("query_id", "list_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order))


def rrf(hits: DataFrame) -> DataFrame:
    """Sums of 1 / rank over the lists."""
    return ranked(hits).groupBy("query_id", "id").agg(F.sum(reciprocal(F.col("rank"))).alias("score"))


def min_max_sum(hits: DataFrame) -> DataFrame:
    """Sums of scores normalised within each list."""
    lists = Window.partitionBy("query_id", "list_id")
    return hits.withColumn("score", min_max(F.col("score"), lists)).groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def _normal(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", min_max(F.col("score"), Window.partitionBy("query_id")))


def weighted(lists: list[DataFrame], alpha: float = 0.5, k: int | None = None) -> DataFrame:
    """A left fold: the result so far, normalised again, weighs alpha against the next list."""

    def fold(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = _normal(a).withColumnRenamed("score", "sa"), _normal(b).withColumnRenamed("score", "sb")
        return left.join(right, ["query_id", "id"], "full_outer").select("query_id", "id", (alpha * F.coalesce("sa", F.lit(0.0)) + (1 - alpha) * F.coalesce("sb", F.lit(0.0))).alias("score"))

    out = reduce(fold, [x.select("query_id", "id", "score") for x in lists])
    return top(out, k) if k else out


def top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(fused: DataFrame, queries: DataFrame, passages: DataFrame, score: Column, k: int = 10) -> DataFrame:
    """Starting from 1 / rank, each query phrasing adds 1 / (1 + rank by ``score``).

    ``fused(query_id, id, rank)``, ``queries(query_id, phrasing, ...)``, ``passages(id, ...)``.
    """
    start = fused.select("query_id", "id", reciprocal(F.col("rank")).alias("score"))
    pairs = fused.select("query_id", "id").join(queries, "query_id").join(passages, "id").withColumn("_s", score)
    order = Window.partitionBy("query_id", "phrasing").orderBy(F.desc("_s"), "id")
    votes = pairs.withColumn("_r", F.row_number().over(order)).select("query_id", "id", (1.0 / (1 + F.col("_r"))).alias("score"))
    return top(start.unionByName(votes).groupBy("query_id", "id").agg(F.sum("score").alias("score")), k)


def rerank_by_vector(fused: DataFrame, queries: DataFrame, passages: DataFrame, k: int = 10) -> DataFrame:
    """``queries(query_id, phrasing, qvec)``, ``passages(id, vec)``."""
    return rerank(fused, queries, passages, cosine(F.col("qvec"), F.col("vec")), k)


def rerank_by_model(fused: DataFrame, queries: DataFrame, passages: DataFrame, k: int = 10) -> DataFrame:
    """``queries(query_id, phrasing)``, ``passages(id, text)``; a null score comes last."""
    return rerank(fused, queries, passages, model("rerank")(F.col("phrasing"), F.col("text")), k)


def by_priority(groups: list[DataFrame]) -> DataFrame:
    """Hits of a group count only for queries that no earlier group answered."""
    out = groups[0]
    for group in groups[1:]:
        out = out.unionByName(group.join(out.select("query_id").distinct(), "query_id", "left_anti"))
    return out


def selected(hits: DataFrame, chosen: DataFrame | None, n: int = 4) -> DataFrame:
    """U8: chosen ``(query_id, rank)`` rows; queries without any get their first n."""
    if chosen is None:
        return hits.where(F.col("rank") <= n)
    picked = hits.join(chosen.select("query_id", "rank").distinct(), ["query_id", "rank"], "left_semi")
    rest = hits.where(F.col("rank") <= n).join(picked.select("query_id").distinct(), "query_id", "left_anti")
    return picked.unionByName(rest)


def reciprocal_ranks(n: int, offset: int) -> Column:
    """U9."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: 1.0 / (r + offset))
