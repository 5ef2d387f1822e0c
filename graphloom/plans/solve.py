"""The answer side (C1, C2, C9): passages to contexts and answers, judged, retried and iterated.

Everything is a DataFrame of queries; a loop runs over attempts or steps, never over
rows.  The models that answer and judge are callables on columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.models import model
from graphloom.operators.fusion import top
from graphloom.plans.logicform import LogicFormRunner, parse_action
from graphloom.session import cut

Attempt = Callable[[DataFrame], DataFrame]


class UnfinishedError(RuntimeError):
    pass


def contexts(hits: DataFrame, passages: DataFrame, k: int = 3, separator: str = "\n\n") -> DataFrame:
    """(query_id, context): the texts of the k best hits (query_id, id, score), best first, joined.

    k is the number of texts that are gathered for a query, so groups are bounded.
    """
    best = top(hits.groupBy("query_id", "id").agg(F.max("score").alias("score")), k).join(passages.select("id", "text"), "id")
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return best.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), separator).alias("context"))


def generated(queries: DataFrame, found: DataFrame, name: str = "answer") -> DataFrame:
    """(query_id, answer) of ``queries(query_id, text)`` by the registered model; queries without context are answered from none."""
    rows = queries.select("query_id", "text").join(found, "query_id", "left")
    return rows.select("query_id", model(name)(F.col("text"), F.coalesce("context", F.lit(""))).alias("answer"))


def static(queries: DataFrame, attempts: list[Attempt], judge: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, answer, attempt, accepted): each query's first answer that the judge accepts.

    An attempt answers the queries that none before it has; what no attempt could
    answer keeps the last one's answer, not accepted.
    """
    accepts = judge or model("judge")
    left, out = queries, None
    for i, attempt in enumerate(attempts):
        got = left.select("query_id").join(attempt(left), "query_id", "left").select("query_id", "answer", F.lit(i).alias("attempt"), F.coalesce(accepts(F.col("answer")), F.lit(False)).alias("accepted"))
        got = cut(got)
        kept = got if i == len(attempts) - 1 else got.where("accepted")
        out = kept if out is None else out.unionByName(kept)
        left = left.join(got.where("accepted").select("query_id"), "query_id", "left_anti")
    return out


def iterative(runner: LogicFormRunner, planner: Callable[[list[tuple[str, DataFrame]]], str | None], most: int = 10) -> DataFrame:
    """One step at a time: the planner sees the steps done and their frames and names the next action, or None to finish.

    Frames are cut, so what the planner looks at is not computed again; ``most``
    steps without an end are an error.
    """
    done: list[tuple[str, DataFrame]] = []
    for _ in range(most):
        action = planner(done)
        if action is None:
            if not done:
                raise UnfinishedError("the planner named no step")
            return done[-1][1]
        parse_action(action)
        frame = cut(runner.run(action))
        done.append((action, frame))
    raise UnfinishedError(f"no end within {most} steps")
