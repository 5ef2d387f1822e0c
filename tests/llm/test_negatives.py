"""Hard negatives against a brute-force version in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import negatives


def brute(rows, every, positives=5, many=3):
    kept = []
    for vec_id, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((vec_id, [math.floor(256 * x) for x in e], label))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out, last = [], 1 << 63
    for i, (a, v, label) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = sorted((-score(v, w), b if b is not None else last, other) for j, (b, w, other) in enumerate(kept) if j != i)
        for s, b, _ in [x for x in scored if x[2] == label][:positives]:
            found = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:many]
            out += [(a, b if b != last else None, n + 1, x[1] if x[1] != last else None, -s, -x[0]) for n, x in enumerate(found)]
    return sorted(out, key=str)


def made(n, dim, seed, spread=0.0, labels=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = math.exp(spread * rng.gauss(0, 1))
        rows.append((i, [float(np.float32(size * rng.gauss(0.3, 1))) for _ in range(dim)], rng.randrange(labels)))
    return rows


AWKWARD = (
    made(60, 4, 1)
    + [(100 + i, [1.0, 0.5, 0.0, 0.25], i % 2) for i in range(30)]
    + [(None, [1.0, 0.5, 0.0, 0.25], 0), (150, [1.0, 0.5, 0.0, 0.25], 0), (150, [1.0, 0.5, 0.0, 0.25], 0), (150, [0.9, 0.5, 0.0, 0.25], 1)]
    + [(200, None, 1), (210, [1.0, None, 0.0, 0.0], 1), (220, [float("nan")] * 4, 1), (230, [float("inf"), 0.0, 0.0, 0.0], 0), (240, [1.0] * 4, None)]
    + [(250, [], 1), (260, [1.0], 1), (270, [0.0] * 4, 2), (280, [-3.0] * 4, 2), (290, [1e5, 1e5, -2e5, 3.0], 1), (291, [1e5, 1e5, -2e5, 2.0], 1), (292, [8e4, 9e4, -2e5, 2.0], 0)]
)
SCHEMA = "vec_id long, embedding array<float>, label int, square string, row string, top string, ids string"


def mined(spark, rows, every):
    df = spark.createDataFrame([(*r, "s", "r", "t", "i") for r in rows], SCHEMA).repartition(3)
    got = negatives.hard_negatives(negatives.digitised(df, F.col("label")), every)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("rows, every, sizes", [(AWKWARD, 10, (7, 1 << 20, 9, 4)), (made(400, 8, 2, 1.0), 5, (4096, 1 << 20, 16384, 512)), (made(120, 8, 3, 1.0), 5, (16, 1 << 20, 16, 4))])
def test_against_brute_force(spark, monkeypatch, rows, every, sizes):
    for name, value in zip(("ROWS", "BYTES", "PORTION", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows, every) == brute(rows, every)


def test_empty(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, [(1, [1.0], 1)], 5) == []
    assert mined(spark, [(5, [1.0], 1)], 5) == []


def test_buckets_are_pruned(monkeypatch):
    """With norms that fall, an anchor whose windows are full computes no product with later buckets."""
    calls = []
    products = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b, bound: calls.append(len(b)) or products(a, b, bound))
    rng = np.random.default_rng(0)
    import pyarrow as pa

    base = rng.normal(1, 0.1, (40, 4))
    vectors = np.vstack([base * 100 / (1 + k) for k in range(5)]).astype(np.int32)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    order = np.argsort(-norms)
    rows = pa.table({"row": order, "vec_id": order, "label": np.zeros(200, np.int64), "vector": pa.array(vectors[order].tolist(), pa.list_(pa.int32())), "square": norms[order] ** 2, "width": np.full(200, 4)})
    monkeypatch.setattr(negatives, "ROWS", 20)
    buckets = list(negatives._packed(rows.to_batches()))
    assert len(buckets) == 10
    portion = negatives.Portion(pa.table({"anchor": [-1], "id": [-1], "label": [0], "vector": pa.array([vectors[0].tobytes()], pa.binary())}))
    portion.windows(np.full((1, 1), -negatives.TOP), np.full((1, 1), negatives.TOP), True, 5)

    class Held:
        value = portion

    found = [b for b in negatives._searched(Held)(buckets)]
    scores = sorted((vectors.astype(np.int64) @ vectors[0].astype(np.int64)).tolist(), reverse=True)[:5]
    assert sorted(found[0].column("score").to_pylist(), reverse=True) == scores
    assert 0 < len(calls) <= 4
