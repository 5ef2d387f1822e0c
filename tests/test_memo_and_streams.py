"""Remembered stages, streams with keyed state and the SQL surface."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators.graph import NODE_SCHEMA, Graph, as_edges
from graphloom.operators.indexes import TextIndex, VectorIndex
from graphloom.operators.store import GraphStore
from graphloom.plans import surface
from graphloom.plans.memo import Memo, row_key
from graphloom.streaming import incremental


def test_memo_computes_what_is_new(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "m"), most=2)
    seen = []

    def build(rows):
        seen.append(sorted(r.text or "" for r in rows.select("text").collect()))
        # none for an empty text, two for others
        return rows.where("text <> ''").select("input_key", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))

    frame = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    result = lambda rows, **o: sorted((r.text, r.n) for r in memo.run("s", rows, build, on=["text"], **o).collect())
    assert result(frame("a", "b", "a", "")) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert result(frame("b", "", "c")) == [("b", 1), ("b", 2), ("c", 1), ("c", 2)]
    assert result(frame("c", "a")) == [("a", 1), ("a", 2), ("c", 1), ("c", 2)]
    assert seen == [["", "a", "b"], ["c"]] and memo.computed["s"] == 0
    # other settings are another stage; many segments are merged
    assert result(frame("a"), settings={"size": 2}) == [("a", 1), ("a", 2)]
    for x in "defg":
        result(frame(x))
    assert result(frame("a", "g")) == [("a", 1), ("a", 2), ("g", 1), ("g", 2)]
    assert seen[-1] == ["g"]


def test_memo_repeats_a_failed_run(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "m"))
    rows = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(RuntimeError):
        memo.run("s", rows, lambda r: (_ for _ in ()).throw(RuntimeError("lost")))
    assert memo.run("s", rows, lambda r: r).count() == 1 and memo.computed["s"] == 1
    assert memo.run("none", rows.limit(0), lambda r: r).count() == 0


def test_row_keys(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"b": "2", "a": "1"}), (3, None), (4, {})], "id int, p map<string,string>")
    keys = [r.k for r in rows.select(row_key(rows, ["p"]).alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def test_replayed_log_builds_each_key_once(spark, tmp_path):
    """Duplicates within and over runs, and a late row, against a batch."""
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    schema = "k string, v int, ts timestamp"
    rows = lambda *x: spark.createDataFrame(x, "k string, v int, t string").select("k", "v", F.to_timestamp("t").alias("ts"))
    run = lambda: incremental.build_incrementally(incremental.log_stream(spark, log, rows().schema, 1), "k", lambda r: r.select("k"), out, state)
    found = lambda: sorted(r.k for r in spark.read.option("recursiveFileLookup", True).schema("k string").parquet(out).collect())
    rows(("a", 1, "2024-01-01"), ("a", 2, "2024-01-02"), ("b", 1, "2024-01-03")).write.parquet(log)
    run()
    assert found() == ["a", "b"]
    rows(("b", 9, "2024-01-04"), ("c", 1, "2023-01-01"), ("c", 2, "2024-01-05")).write.mode("append").parquet(log)
    run()
    run()
    assert found() == ["a", "b", "c"] and schema


def test_batches_reach_the_stored_graph(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    to_graph = lambda rows: Graph(rows.select("id", "id", F.lit("A").alias("label"), F.create_map(F.lit("n"), F.col("n")).alias("properties")).toDF("id", "name", "label", "properties"), Graph.empty(spark).edges)
    step = incremental.add_to_graph(store, to_graph, str(tmp_path / "done"))
    one, two = (spark.createDataFrame([("x", n)], "id string, n string") for n in "12")
    for batch, number in ((one, 0), (two, 1), (one, 0)):
        step(batch, number)
    assert [r.properties for r in store.read().nodes.collect()] == [{"n": "2"}]


def test_windows_of_a_stream(spark, tmp_path):
    """Windows and sessions equal those of a batch once the watermark has passed them."""
    log = str(tmp_path / "log")
    times = ["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 01:10", "2024-01-01 05:00", "2024-01-09 00:00"]
    rows = spark.createDataFrame([("u", float(i), t) for i, t in enumerate(times)], "k string, value double, t string").select("k", "value", F.to_timestamp("t").alias("ts"))
    rows.coalesce(1).write.parquet(log)
    stream = lambda: incremental.log_stream(spark, log, rows.schema)
    got = incremental.drain(incremental.windowed_counts(stream(), ["k"])).where("window.start < '2024-01-05'")
    assert sorted((r.window.start.hour, r.n, r.total) for r in got.collect()) == [(0, 2, 1.0), (1, 1, 2.0), (5, 1, 3.0)]
    got = incremental.drain(incremental.sessions(stream(), "k")).where("session_window.start < '2024-01-05'")
    assert sorted(r.n for r in got.collect()) == [1, 1, 2]


def test_sql_text(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "one", "Big Thing", {"the size": "3.5", "word": "x"}), ("2", "two", "Big Thing", {"the size": "none"})], NODE_SCHEMA)
    edges = as_edges(spark.createDataFrame([("1", "2")], "s string, o string"), F.col("s"), "Big Thing", "has", F.col("o"), "Big Thing")
    names = surface.register(spark, Graph(nodes, edges), "t_", {"Big Thing": {"the size": "double", "word": "string"}})
    assert names == ["t_nodes", "t_edges", "t_big_thing"]
    sql = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert sql("SELECT id, the_size FROM t_big_thing ORDER BY id") == [("1", 3.5), ("2", None)]
    assert sql("SELECT * FROM t_one_hop('2', 'Big Thing')") == [("in", "has", "1", "Big Thing")]
    assert sql("SELECT value FROM t_attributes('1', 'Big Thing') WHERE property = 'word'") == [("x",)]
    assert sql("SELECT graph_cosine(array(1D, 0D), array(1D, 1D)) > 0.7, token_jaccard('a b', 'B c'), rank_score(4)") == [(True, 1 / 3, 0.25)]
    index = TextIndex.build(spark.createDataFrame([(1, "a b a"), (2, "b")], "id int, text string"), str(tmp_path / "t"))
    surface.register_text_index(spark, index, "i")
    assert sql("SELECT term, id, tf FROM i_postings ORDER BY term, id") == [("a", 1, 2), ("b", 1, 1), ("b", 2, 1)]
    vectors = VectorIndex.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vec array<double>"), str(tmp_path / "v"))
    surface.register_vector_index(spark, vectors, "vi")
    assert sql("SELECT id FROM (SELECT id, graph_dot(vec, array(0D, 2D)) AS s FROM vi) ORDER BY s DESC LIMIT 1") == [(2,)]
