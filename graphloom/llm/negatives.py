"""Operator 12: hard negatives by a norm-bucketed search.

Candidates are sorted by falling norm and packed into buckets with the largest norm of
each.  No inner product in a bucket exceeds the anchor's norm times that (Cauchy and
Schwarz), so an anchor skips a bucket whose bound lies below what it still needs: its
running k-th score and, for negatives, the lower limit of each of its windows.  The
buckets of the largest norms are searched first; the k-th scores found there go to all
tasks that search the rest.

Anchors are a stated query set.  They are searched in portions of about ``PORTION``
rows, so what is broadcast (a portion's vectors and limits) has a fixed bound, and each
portion reads the buckets four times: positives and negatives, the head and the rest.
Buckets hold at most ``ROWS`` rows and about ``BYTES`` bytes, whatever the labels or copies of
vectors are, so no label and no vector makes a large task.

Rows with a null label, a null vector, or a null or non-finite component take no part.
Components are ``floor(scale * x)``, cut to 2 ** 27 in size; missing components count
as zero; scores beyond 64 bits are cut to them.  Ties go to the smaller vec_id, a null
one last; rows of equal vec_id are rows of their own, and an anchor that occurs twice
is answered twice.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut, discard, shared_dir, shuffle_partitions, stored

#: Rows and bytes of a bucket; anchors of a portion; anchors that meet a bucket at a time.
ROWS, BYTES, PORTION, BLOCK = 4096, 1 << 20, 16384, 512
LARGEST = 1 << 27
#: Beyond all scores; it also stands for a null vec_id, after all others.
TOP = np.iinfo(np.int64).max
NO_ID = TOP
BUCKET = "bucket long, top double, rows array<long>, ids array<long>, labels array<long>, width int, vectors binary"
FOUND = "anchor long, window int, score long, id long"
#: Slack of bounds that are computed in floating point.
SLACK = 1 + 1e-9


def digitised(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector, square) of the rows that take part; ``square`` is the squared norm."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(F.lit(scale) * v.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    kept = rows.where(F.col("label").isNotNull() & x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vector"))
    return kept.withColumn("square", F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _packed(batches):
    """Buckets of the sorted rows."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        at = 0
        while at < table.num_rows:
            width = max(1, int(table.column("width").slice(at, ROWS).to_numpy().max()))
            size = max(1, min(ROWS, BYTES // (4 * width)))
            if table.num_rows - at < size:
                break
            yield _bucket(table.slice(at, size))
            at += size
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield _bucket(rest)


def _bucket(table: pa.Table) -> pa.RecordBatch:
    vectors = table.column("vector").to_pylist()
    width = max(map(len, vectors), default=0)
    matrix = np.zeros((len(vectors), width), np.int32)
    for i, v in enumerate(vectors):
        matrix[i, : len(v)] = v
    ids = [NO_ID if v is None else v for v in table.column("vec_id").to_pylist()]
    rows = table.column("row").to_pylist()
    row = {"bucket": rows[0], "top": math.sqrt(max(table.column("square").to_pylist())) * SLACK, "rows": rows, "ids": ids, "labels": table.column("label").to_pylist(), "width": width, "vectors": matrix.tobytes()}
    schema = pa.schema([("bucket", pa.int64()), ("top", pa.float64()), *((c, pa.list_(pa.int64())) for c in ("rows", "ids", "labels")), ("width", pa.int32()), ("vectors", pa.binary())])
    return pa.RecordBatch.from_pylist([row], schema)


def buckets_of(vectors: DataFrame) -> tuple[DataFrame, str]:
    """The stored buckets; ``bucket`` rises as norms fall."""
    spark = vectors.sparkSession
    order = [F.desc("square"), F.col("vec_id"), F.col("label")]
    rows = vectors.withColumn("width", F.size("vector")).repartitionByRange(shuffle_partitions(spark), *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_packed, BUCKET), "buckets")


def _unpacked(batch):
    """Buckets of a batch: name, largest norm, rows, ids, labels, matrix."""
    for r in batch.to_pylist():
        n = len(r["rows"])
        yield r["bucket"], r["top"], *(np.array(r[c], np.int64) for c in ("rows", "ids", "labels")), np.frombuffer(r["vectors"], np.int32).reshape(n, r["width"])


def _anchors(every: int):
    def run(batches):
        for batch in batches:
            for _, _, rows, ids, labels, matrix in _unpacked(batch):
                at = np.flatnonzero((ids != NO_ID) & (ids % every == 0))
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids[at]), pa.array(labels[at]), pa.array([matrix[i].tobytes() for i in at], pa.binary())], ["anchor", "id", "label", "vector"])

    return run


class Portion:
    """Anchors that are searched together, by falling norm: their vectors, and the limits of their windows.

    A window is a range of scores, ``low`` to ``high``, of which the best ``k`` are wanted;
    ``need`` is the score below which nothing can count any more.
    """

    def __init__(self, rows: pa.Table):
        vectors = [np.frombuffer(v, np.int32) for v in rows.column("vector").to_pylist()]
        matrix = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int32)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        self.norm = np.sqrt((matrix.astype(np.float64) ** 2).sum(1)) * SLACK
        order = np.argsort(-self.norm, kind="stable")
        self.matrix, self.norm = matrix[order], self.norm[order]
        self.row, self.id, self.label = (rows.column(c).to_numpy()[order] for c in ("anchor", "id", "label"))
        self.place = {r: i for i, r in enumerate(self.row.tolist())}
        self.low = self.high = self.need = np.zeros((len(order), 0), np.int64)
        self.same, self.k = True, 0

    def windows(self, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> None:
        self.low, self.high, self.need, self.same, self.k = low, high, low.copy(), same, k

    def raise_needs(self, found: pa.Table) -> None:
        """The k-th scores of the windows that are full in ``found``, the best of each window."""
        i = np.array([self.place[r] for r in found.column("anchor").to_pylist()], np.int64)
        w, score = found.column("window").to_numpy().astype(np.int64), found.column("score").to_numpy()
        count, least = np.zeros(self.low.shape, np.int64), np.full(self.low.shape, TOP)
        np.add.at(count, (i, w), 1)
        np.minimum.at(least, (i, w), score)
        self.need = np.where(count >= self.k, np.maximum(self.need, least), self.need)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows, exact: in floating point while that is, else in integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if bound < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if bound < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -TOP, TOP).astype(np.int64)


def _best(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The best k (anchor, score, id) of each anchor."""
    who, score, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, -score, who))
    who, score, ids = who[order], score[order], ids[order]
    new = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(new, np.diff(np.append(new, len(who))))
    keep = rank < k
    return who[keep], score[keep], ids[keep]


def _searched(held):
    """The best of each window among the buckets of a task."""

    def run(batches):
        p: Portion = held.value
        need, k = p.need.copy(), p.k
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = [none] * need.shape[1]
        for batch in batches:
            for _, top, rows, ids, labels, matrix in _unpacked(batch):
                for lo in range(0, len(p.row), BLOCK):
                    at = np.arange(lo, min(lo + BLOCK, len(p.row)))
                    # Cauchy and Schwarz: what an anchor can reach here against the least that it still needs
                    at = at[p.norm[at] * top >= need[at].min(1, initial=TOP)]
                    for label in np.unique(labels if p.same else p.label[at]).tolist() if len(at) else []:
                        who, which = at[p.label[at] == label], np.flatnonzero((labels == label) == p.same)
                        if not len(who) or not len(which):
                            continue
                        scores = products(p.matrix[who], matrix[which], float(p.norm[who].max()) * top)
                        hit = (scores >= need[who].min(1)[:, None]) & (scores <= p.high[who].max(1)[:, None])
                        if p.same:
                            hit &= p.row[who][:, None] != rows[which][None, :]
                            if len(which) > k + 1:  # of one window: no more than its best here, with their ties
                                least = np.partition(np.where(hit, scores, -TOP), -k, axis=1)[:, -k]
                                hit &= scores >= least[:, None]
                        i, j = np.nonzero(hit)
                        score = scores[i, j].astype(np.int64)
                        i, j = who[i], ids[which[j]]
                        for w in range(need.shape[1]):
                            inside = (score >= need[i, w]) & (score <= p.high[i, w])
                            if not inside.any():
                                continue
                            best[w] = _best([best[w], (i[inside], score[inside], j[inside])], k)
                            full = np.flatnonzero(np.bincount(best[w][0], minlength=len(p.row)) == k)
                            last = np.searchsorted(best[w][0], full, "right") - 1
                            need[full, w] = np.maximum(need[full, w], best[w][1][last])
        for w, (who, score, ids) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(p.row[who]), pa.array(np.full(len(who), w, np.int32)), pa.array(score), pa.array(ids)], ["anchor", "window", "score", "id"])

    return run


def _search(portion: Portion, head: DataFrame, rest: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(anchor, window, score, id, rank) of the best of each window over all buckets, the head first."""
    spark = head.sparkSession
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")

    def searched(part: DataFrame, known: DataFrame | None) -> tuple[DataFrame, str]:
        held = spark.sparkContext.broadcast(portion)
        found = part.mapInArrow(_searched(held), FOUND)
        found = found if known is None else found.unionByName(known.drop("rank"))
        done = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= portion.k), name)
        held.unpersist()
        return done

    first, path = searched(head, None)
    portion.raise_needs(first.select("anchor", "window", "score").toArrow())
    both = searched(rest, first)
    discard(spark, path)
    return both


def hard_negatives(vectors: DataFrame, every: int, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Of each anchor (vec_id divisible by ``every``) and each of its first ``positives`` rows of the same label: the
    first ``negatives`` rows of other labels that score ``low`` to ``high`` hundredths of the positive.

    ``vectors`` as ``digitised`` gives them.
    """
    spark = vectors.sparkSession
    buckets, bucket_path = buckets_of(vectors)
    made = [bucket_path]
    result = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    try:
        anchors, path = stored(buckets.mapInArrow(_anchors(every), "anchor long, id long, label long, vector binary"), "anchors")
        made.append(path)
        portions = max(1, -(-anchors.count() // PORTION))
        # rows are numbered from a multiple of 2 ** 33 in each range of norms
        head, rest = buckets.where(F.col("bucket") < 1 << 33), buckets.where(F.col("bucket") >= 1 << 33)
        for n in range(portions):
            rows = anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(portions)) == n).toArrow()
            portion = Portion(rows)
            size = len(portion.row)
            portion.windows(np.full((size, 1), -TOP), np.full((size, 1), TOP), True, positives)
            pairs, pairs_path = _search(portion, head, rest, "positives")
            got = pairs.select("anchor", "rank", "score").toArrow()
            place = np.array([portion.place[r] for r in got.column("anchor").to_pylist()], np.int64)
            rank, score = got.column("rank").to_numpy().astype(np.int64) - 1, got.column("score").to_pylist()
            # a window that no score is in where there is no positive
            floor, ceiling = np.full((size, positives), TOP), np.full((size, positives), -TOP)
            floor[place, rank] = [-(-low * s // 100) for s in score]
            ceiling[place, rank] = [high * s // 100 for s in score]
            empty = floor > ceiling
            portion.windows(np.where(empty, TOP, floor), np.where(empty, -TOP, ceiling), False, negatives)
            found, found_path = _search(portion, head, rest, "negatives")
            positive = pairs.select("anchor", (F.col("rank") - 1).alias("window"), _id("id").alias("positive_id"), F.col("score").alias("positive_score"))
            answers = found.select("anchor", "window", "rank", _id("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positive, ["anchor", "window"])
            answers = answers.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
            answers.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(result)
            discard(spark, pairs_path)
            discard(spark, found_path)
        made.append(result)
        return cut(spark.read.parquet(result))
    finally:
        for path in made:
            discard(spark, path)


def _id(name: str) -> Column:
    return F.when(F.col(name) != int(NO_ID), F.col(name))
