"""Evaluation metrics over DataFrames (A5, A8-A10, 2.14)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import CJK, exact_match, token_f1

TOKEN = re.compile(rf"[{CJK}]|[^\s{CJK}]+")


def answer_scores(answers: DataFrame) -> DataFrame:
    """A10: mean EM and F1 of ``answers(question_id, prediction, gold)``, the best gold alias a question."""
    each = answers.select("question_id", exact_match(F.col("prediction"), F.col("gold")).alias("em"), token_f1(F.col("prediction"), F.col("gold")).alias("f1"))
    best = each.groupBy("question_id").agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    return best.agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.lit(0.0).alias("answer_similarity"))


def recall_at(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (3, 5), fuzzy: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """Share of a question's gold titles among its first k hits, and among all.

    ``hits(question_id, title, rank)``, ``gold(question_id, title)``.  Titles match if
    they are equal; with ``fuzzy`` also if one contains the other (A8), which looks
    through the question's hits, a ranked list of known length.

    With ``groups(question_id, group)``, gold is (group, title), the titles of all the
    group's questions: they are counted once a group, not once a question.
    """
    key = "question_id" if groups is None else "group"
    gold = gold.select(key, "title").distinct()
    asked = gold.select("question_id").distinct() if groups is None else groups.select("question_id", "group").distinct().join(gold.select("group").distinct(), "group", "left_semi")
    if fuzzy:
        listed = hits.groupBy("question_id").agg(F.collect_set(F.struct("rank", F.col("title").cast("string").alias("title"))).alias("hs"))
        near = F.filter("hs", lambda h: F.contains(h["title"], F.col("title").cast("string")) | F.contains(F.col("title").cast("string"), h["title"]))
        met = asked.join(listed, "question_id").join(gold, key).withColumn("rank", F.array_min(F.transform(near, lambda h: h["rank"])))
    else:
        met = hits.groupBy("question_id", "title").agg(F.min("rank").alias("rank")).join(asked, "question_id").join(gold, [key, "title"], "left_semi")
    counted = lambda hit: F.sum(F.when(hit, 1).otherwise(0))
    each = [f"recall_{k}" for k in (*ks, "all")]
    # titles of several groups of a question count once
    met = met.groupBy("question_id", "title").agg(F.min("rank").alias("rank"))
    met = met.groupBy("question_id").agg(*[counted(F.col("rank") <= k).alias(f"recall_{k}") for k in ks], counted(F.col("rank").isNotNull()).alias("recall_all"))
    several = None if groups is None else asked.groupBy("question_id").agg(F.count(F.lit(1)).alias("in")).where("in > 1")
    if several is None:
        of = gold.groupBy("question_id").agg(F.count(F.lit(1)).alias("of"))
    else:
        own = asked.join(gold.groupBy("group").agg(F.count(F.lit(1)).alias("of")), "group").join(several, "question_id", "left_anti").select("question_id", "of")
        of = own.unionByName(asked.join(several, "question_id", "left_semi").join(gold, "group").select("question_id", "title").distinct().groupBy("question_id").agg(F.count(F.lit(1)).alias("of")))
    per = of.join(met, "question_id", "left").select(*[(F.coalesce(c, F.lit(0)) / F.col("of")).alias(c) for c in each])
    return per.agg(*[F.avg(c).alias(c) for c in each])


def fuzzy_sets(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Members of one array that contain or are contained in a member of the other, and those that are not."""
    hit = lambda a, b: F.filter(a, lambda x: F.exists(b, lambda y: F.contains(y, x) | F.contains(x, y)))
    common = hit(F.col(left), F.col(right))
    return pairs.withColumns({"common": common, "only_left": F.array_except(F.col(left), common)})


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    """A5: F of the longest common subsequence of tokens: words, and single CJK characters; a sequential recurrence, so an Arrow UDF."""

    def one(a: str | None, b: str | None) -> float:
        x, y = TOKEN.findall(a or ""), TOKEN.findall(b or "")
        if not x or not y:
            return 0.0
        row = [0] * (len(y) + 1)
        for s in x:
            corner = 0
            for j, t in enumerate(y, 1):
                corner, row[j] = row[j], corner + 1 if s == t else max(row[j], row[j - 1])
        return 2.0 * row[-1] / (len(x) + len(y))

    return pd.Series([one(a, b) for a, b in zip(prediction, gold, strict=True)], dtype="float64")
