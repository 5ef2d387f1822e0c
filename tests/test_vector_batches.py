"""Batches of vector queries against the column functions, on odd vectors, and in one scan."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine, dot
from graphloom.operators import search

NAN, INF = float("nan"), float("inf")
VECTORS = [[0.1, 0.7], [0.7, 0.1], [0.1, 0.7], None, [0.3], [0.2, None], [NAN, 0.0], [INF, 1.0], [], [0.0, 0.0], [-0.1, 0.3], [1e-9, 0.7], [0.1, 0.7000000000000001]]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i + 100 * n, "ab"[i % 2] if i % 5 else None, v) for n in range(3) for i, v in enumerate(VECTORS)]
    return spark.createDataFrame([*made, (None, "a", [0.1, 0.7])], "id long, label string, vec array<double>").repartition(3).checkpoint()


@pytest.fixture(autouse=True)
def small_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    monkeypatch.setattr(search, "PAIRS", 16)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module", autouse=True)
def shared(spark):
    search.cut(spark.range(1))


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_as_column_functions(rows, k, kind):
    rows = rows.withColumn("id", F.col("id").cast(kind))
    queries = rows.where("id < 100").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    pairs = rows.crossJoin(queries).select("query_id", "id", dot(F.col("vec"), F.col("qvec")).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    assert plain(search.top_vectors_batch(rows, queries, k)) == plain(want)


def test_links_as_column_functions(rows):
    x, y = rows.where("id < 100").select(F.col("id").alias("a"), F.col("label").alias("l"), F.col("vec").alias("v")), rows
    pairs = x.join(y, (x.l == y.label) & (x.a != y.id)).select("a", F.col("id").alias("b"), cosine(F.col("v"), F.col("vec")).alias("score")).where("score >= 0.1")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    want = pairs.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    assert plain(search.similar_links(rows, rows.where("id < 100"), 0.1)) == plain(want)


def test_many_queries_take_one_scan(spark):
    """600 queries are no longer three scans."""
    rows = spark.range(700).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    found = search.top_vectors_batch(rows, rows.where("id < 600").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert found.where("query_id = 599 AND rank = 1").first()["id"] == 699


def test_recall_by_groups(spark):
    """Gold of a group counts as if each of its questions had it, without a row for each."""
    from graphloom.functions import metrics

    hits = spark.createDataFrame([(1, "x", 1), (1, "y", 4), (2, "z", 2), (3, "xy", 6), (3, "x", 7)], "question_id long, title string, rank int")
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "a"), (4, "none"), (5, "b")], "question_id long, group string")
    gold = spark.createDataFrame([("a", "x"), ("a", "z"), ("a", "z"), ("b", "y"), ("b", "x"), (None, "q")], "group string, title string")
    each = gold.join(groups, "group").select("question_id", "title")
    for fuzzy in (False, True):
        assert metrics.recall_at(hits, gold, fuzzy=fuzzy, groups=groups).first() == metrics.recall_at(hits, each, fuzzy=fuzzy).first()
    assert metrics.recall_at(hits, each).first() == pytest.approx((0.25, 0.25, 1 / 3))
