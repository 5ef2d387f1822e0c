"""Operator 5: line deduplication against levelled sorted runs of line hashes.

Documents are taken in batches of ascending doc_id.  A batch hashes its lines,
keeps per key the smallest and largest doc_id (combined before the shuffle),
merge-anti-joins the runs of earlier batches and adds the keys that are new as a
run of its own, sorted by hash.  Runs form levels: when ``fan_in`` runs of a level
exist they are merged into one run of the next.  As every run is bucketed and
sorted by the hash, anti-joins read runs without a shuffle of their own.

A key is dropped from every document but the first that holds it, so all lines of
a key stay in the smallest doc_id.  Keys are 128-bit hashes; a line is compared
stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased.

Very long texts are split whole; of equal lines the smallest doc_id keeps all of its own.
Null or empty texts are one empty line, which is never dropped; rows with equal
doc_id count as one document; a null doc_id comes before all others; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import BLANKS, sliced, widened
from graphloom.session import cut, shared_dir, shuffle_partitions

#: Stands for a null doc_id in comparisons: smaller than every doc_id.
NULL_ID = -(1 << 63)
#: Working columns, named so that they meet no column of the table.
DOC, DROPPED = "__line_doc", "__line_dropped"
KEYS = "h1 long, h2 long, doc long"


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, None if it has fewer than ``least`` code points."""
    key = line.strip(BLANKS)
    if len(key) < least:
        return None
    if len(key) < 4 * least and len(key.decode()) < least:
        return None
    return key.lower()  # bytes.lower() changes A-Z only


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key_rows(least: int):
    """Distinct (key hash, document) of each slice."""

    def run(batches):
        for batch in sliced(batches):
            ids = batch.column("doc").to_pylist()
            seen: dict[bytes, list[int]] = {}
            for doc, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                for line in (text or "").encode().split(b"\n"):
                    if (key := line_key(line, least)) is not None:
                        span = seen.get(key)
                        if span is None:
                            seen[key] = [doc, doc]
                        elif doc < span[0]:
                            span[0] = doc
                        elif doc > span[1]:
                            span[1] = doc
            digests = [xxhash.xxh3_128_digest(k) for k in seen]
            pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2) if digests else np.zeros((0, 2), np.int64)
            spans = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["h1", "h2", "low", "high"])

    return run


def _line_rows(least: int):
    """(key hash, document) of each keyed line, once a document and slice."""

    def run(batches):
        for batch in sliced(batches):
            out = set()
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for line in (text or "").encode().split(b"\n"):
                    if (key := line_key(line, least)) is not None:
                        out.add((xxhash.xxh3_128_digest(key), doc))
            pairs = np.frombuffer(b"".join(k for k, _ in out), ">i8").astype(np.int64).reshape(-1, 2) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([d for _, d in out], pa.int64())], ["h1", "h2", "doc"])

    return run


def _strip_rows(least: int, names: list[str]):
    """Texts without the lines whose key hash is in ``DROPPED``."""

    def run(batches):
        for batch in sliced(batches):
            texts, n_lines, n_dropped, shas = [], [], [], []
            for text, dropped in zip(batch.column("text").to_pylist(), batch.column(DROPPED).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                kept = lines
                if dropped:
                    gone = set(dropped)
                    kept = [x for x in lines if (key := line_key(x, least)) is None or xxhash.xxh3_128_digest(key) not in gone]
                joined = b"\n".join(kept)
                texts.append(None if text is None else joined.decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                shas.append(hashlib.sha256(joined).hexdigest())
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(shas, pa.string())], [*names, "n_lines", "n_dropped", "kept_sha256"])

    return run


class Runs:
    """The levels; every run is a bucketed, sorted table in the shared folder.

    Buckets are those of a shuffle by the same columns into as many partitions, so a
    task writes one file, and joins on the hash move no run.
    """

    def __init__(self, spark: SparkSession, fan_in: int, buckets: int):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets
        self.root = f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[DataFrame]] = []
        self.made: list[str] = []

    def spread(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "h1", "h2")

    def write(self, keys: DataFrame) -> DataFrame:
        """``keys``, which ``spread`` has dealt, as a table."""
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{name}").saveAsTable(name)
        self.made.append(name)
        return self.spark.table(name)

    def add(self, run: DataFrame) -> None:
        """A new run at level 0; full levels are compacted upwards."""
        level = 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            whole = self.levels[level][0]
            for other in self.levels[level][1:]:
                whole = whole.unionByName(other)
            # runs hold disjoint keys, so a merge is their sorted union
            run = self.write(self.spread(whole))
            self.levels[level], level = [], level + 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def forget(self) -> None:
        for name in self.made:  # external tables: the files stay in the shared folder
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, least: int = 10, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """``docs`` with repeated lines dropped, and n_lines, n_dropped, kept_sha256, which replace columns of these names.

    ``batches`` increments of about equal row counts are cut at quantiles of
    doc_id, ``fan_in`` runs make a level full.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_sha256", DOC, DROPPED)
    names = docs.columns
    keyed = docs.withColumn(DOC, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    points = sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *(int(x) for x in points), None]
    runs = Runs(spark, fan_in, shuffle_partitions(spark))
    # keys to drop, with the one document that keeps them
    drops: DataFrame | None = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = keyed
        if low is not None:
            part = part.where(F.col("doc_id") > low)  # the column itself, so that files can be skipped
        if high is not None:
            part = part.where((F.col("doc_id") <= high) | F.col("doc_id").isNull() if low is None else F.col("doc_id") <= high)
        keys = part.select(F.col(DOC).alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(_key_rows(least), "h1 long, h2 long, low long, high long")
        # slices have combined equal keys already
        keys = runs.spread(keys).groupBy("h1", "h2").agg(F.min("low").alias("doc"), F.max("high").alias("high"))
        owner = F.lit(None).cast("long")
        for i, run in enumerate(runs.runs()):
            keys = keys.join(run.select("h1", "h2", F.col("doc").alias(f"owner{i}")), ["h1", "h2"], "left")
            owner = F.coalesce(owner, F.col(f"owner{i}"))
        batch = runs.write(keys.select("h1", "h2", "doc", "high", owner.alias("owner")))
        found = batch.where("owner IS NOT NULL OR high > doc").select("h1", "h2", F.coalesce("owner", "doc").alias("doc"))
        drops = found if drops is None else drops.unionByName(found)
        if high is not None:
            runs.add(batch.where("owner IS NULL").select("h1", "h2", "doc"))
    drops = cut(drops.groupBy("h1", "h2").agg(F.min("doc").alias("owner")))
    runs.forget()
    rows = keyed.select(F.col(DOC).alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(_line_rows(least), KEYS)
    gone = (
        rows.join(drops, ["h1", "h2"])
        .where(F.col("doc") > F.col("owner"))
        .groupBy(F.col("doc").alias(DOC))
        .agg(F.collect_set(F.concat(F.unhex(F.lpad(F.hex("h1"), 16, "0")), F.unhex(F.lpad(F.hex("h2"), 16, "0")))).alias(DROPPED))
    )
    joined = keyed.join(gone, DOC, "left").select(*[F.col(f"`{n}`") for n in names], DROPPED)
    return joined.mapInArrow(_strip_rows(least, names), widened(docs, "n_lines long, n_dropped long, kept_sha256 string"))
