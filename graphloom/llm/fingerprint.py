"""Operator 6: document fingerprints by a randomised edit embedding.

A shared random walk turns a text into a longer string: at step j the current
character c is written, and the walk goes on to the next character if the random bit
``R[c, j]`` is 1.  All texts share R, so two texts that differ by few edits fall into
step again, and the edit distance becomes a Hamming distance of the embedded strings.
R has ``CLASSES`` rows; a character beyond U+007F walks by a row that a hash of its code
point chooses, so such characters may walk alike, but what is sampled tells them apart.

The fingerprint keeps ``SAMPLES`` sampled places of the embedded string, four bits of
a hash of the place's code point and the sample each.  Places are drawn evenly over the whole length, consistently: sample s
takes the last record of a random sequence before the string's end, so strings of
nearly equal length share most places.  ``near_pairs`` bands the sampled bits and
verifies what meets in a band.

Texts of one batch walk in lockstep, one character of every text at a time, so the
work is linear in the characters, whole texts included.

Null and empty texts have the fingerprint of no characters; equal texts have equal
fingerprints; repeated rows follow each other in the order of their texts; a table of
one row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import mix, sliced, widened
from graphloom.session import cut, shuffle_partitions

SAMPLES, CLASSES, PERIOD = 128, 256, 4096
#: The hash of the place without a character, beyond all code points.
NOTHING = np.uint64(1 << 32)
NULL_ID = -(1 << 63)
#: Classes of a bucket that are compared with each other at a time, on average.
BLOCK_ROWS = 1024
#: Buckets that are broadcast at most; more are joined by shuffle.
BROADCAST_BANDS = 1_000_000


class Walk:
    """The shared random choices, made from one seed."""

    def __init__(self, seed: int = 23):
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (CLASSES, PERIOD)).astype(bool)
        bits[:, -1] = True
        # steps from place j until the walk has left a character of class c
        step = np.ones((CLASSES, PERIOD), np.uint16)
        for j in range(PERIOD - 2, -1, -1):
            step[:, j] = np.where(bits[:, j], 1, step[:, j + 1] + 1)
        self.step = step.reshape(-1)
        self.salt = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.records = []
        for _ in range(SAMPLES):
            places, j = [0], 0
            while j < 1 << 40:  # a record at m has odds 1 / (m + 1)
                j = int((j + 1) / max(rng.random(), 1e-12))
                places.append(j)
            self.records.append(np.array(places))

    def fingerprints(self, texts: list[str]) -> list[str]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(points < 128, points, (128 + (mix(points.astype(np.uint64)) & np.uint64(127)).astype(np.uint32))).astype(np.uint32)
        shifted = kind * np.uint32(PERIOD)
        offs = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(-lengths, kind="stable")
        at = offs[:-1][order].copy()
        place = np.zeros(len(texts), np.int64)
        starts = np.zeros(len(points) + 1, np.int64)
        step, mask = self.step, PERIOD - 1
        # texts still walking at each character
        walking = np.searchsorted(-lengths[order], -np.arange(1, (int(lengths.max()) if len(texts) else 0) + 1), "right")
        for active in walking.tolist():
            i, p = at[:active], place[:active]
            starts[i] = p
            p += step[shifted[i] + (p & mask)]
            i += 1
        end = np.empty(len(texts), np.int64)
        end[order] = place
        picks = np.stack([r[np.searchsorted(r, np.maximum(end, 1), "left") - 1] for r in self.records], 1)
        out = np.empty((len(texts), SAMPLES), np.uint8)
        for n, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            if hi > lo:
                char = lo + np.searchsorted(starts[lo:hi], picks[n], "right") - 1
                out[n] = mix(points[char].astype(np.uint64) ^ self.salt) >> np.uint64(60)
            else:
                out[n] = mix(NOTHING ^ self.salt) >> np.uint64(60)
        packed = out[:, ::2] << 4 | out[:, 1::2]
        return [row.tobytes().hex() for row in packed]


def likeness_of(a: list[str], b: list[str]) -> np.ndarray:
    """Share of equal places, corrected for chance, of aligned fingerprints."""
    if not a:
        return np.zeros(0)
    x, y = (np.frombuffer("".join(s).encode(), np.uint8).reshape(len(s), SAMPLES) for s in (a, b))
    return np.clip(((x == y).mean(1) - 1 / 16) * 16 / 15, 0.0, 1.0)


def likeness(a: Column, b: Column) -> Column:
    """``likeness_of`` for columns."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), (same / SAMPLES - 1 / 16) * 16 / 15)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with the fingerprint of ``text``, which replaces a column of this name."""
    docs = docs.drop("fingerprint")
    names = docs.columns

    def run(batches):
        walk = Walk()
        for batch in sliced(batches):
            made = walk.fingerprints([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.string())], [*names, "fingerprint"])

    return docs.mapInArrow(run, widened(docs, "fingerprint string"))


def _groups(batches):
    """(key, rows) of each group of the sorted rows."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        if not part.num_rows:
            continue
        keys = list(zip(*(part.column(c).to_pylist() for c in ("band", "lo", "hi")), strict=True))
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield keys[lo], part.slice(lo, hi - lo)
        rest = part.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield (rest.column("band")[0].as_py(), rest.column("lo")[0].as_py(), rest.column("hi")[0].as_py()), rest


def _verify(least: float, bands: int, every: bool):
    """Near pairs of each group whose first common band is the group's."""
    width = SAMPLES // bands

    def run(batches):
        for (band, low, high), rows in _groups(batches):
            n, number = rows.num_rows, int(band.split(":")[0])
            if n < 2:
                continue
            side = np.array(rows.column("block").to_pylist()) == high
            ids = rows.column("doc_id").to_pylist()
            places = np.frombuffer("".join(rows.column("fingerprint").to_pylist()).encode(), np.uint8).reshape(n, SAMPLES)
            root, out = list(range(n)), []

            def find(i, root=root):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            left, right = (np.arange(n), np.arange(n)) if low == high else (np.flatnonzero(~side), np.flatnonzero(side))
            for i in left.tolist():
                others = right[right > i] if low == high else right
                if not len(others):
                    continue
                same = places[others] == places[i]
                near = np.clip((same.mean(1) - 1 / 16) * 16 / 15, 0.0, 1.0)
                at = np.flatnonzero(near >= least)
                first = same[at, : bands * width].reshape(len(at), bands, width).all(2).argmax(1) == number
                for k in at[first].tolist():
                    j = int(others[k])
                    x, y = find(i), find(j)
                    if every or x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(near[k])))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip("ab", o, strict=False), near=o[2]) for o in out], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.float64())]))

    return run


def near_pairs(prints: DataFrame, least: float = 0.8, bands: int = 32, block: int = BLOCK_ROWS, every: bool = False) -> DataFrame:
    """(a, b, near): likenesses of at least ``least`` among ``prints(doc_id, fingerprint)``.

    Equal fingerprints are one class, named by its smallest doc_id.  A band is a run
    of sampled places.  There are more bands than places in which near fingerprints
    may differ (``bands`` is doubled until there are), so any two of them meet in a
    band.  Each bucket is searched exhaustively: those of more than ``block`` classes
    are split by hash, and all pairs of splits are compared in place.  A pair counts
    in its first common band only.

    The pairs given connect all near classes; with ``every`` they are all near pairs,
    of which large groups of near copies have the square of their size.
    """
    while bands < SAMPLES and sum(max(0.0, ((SAMPLES - d) / SAMPLES - 1 / 16) * 16 / 15) >= least for d in range(bands, SAMPLES + 1)):
        bands = min(SAMPLES, 2 * bands)
    width = SAMPLES // bands
    spark = prints.sparkSession
    classes = prints.groupBy("fingerprint").agg(F.min(F.col("doc_id").cast("long")).alias("doc_id")).where("doc_id IS NOT NULL AND fingerprint IS NOT NULL")
    keys = F.array(*[F.concat(F.lit(f"{i}:"), F.substring("fingerprint", 1 + i * width, width)) for i in range(bands)])
    rows = classes.select("doc_id", "fingerprint", F.explode(keys).alias("band"))
    sizes = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    if sizes.count() <= BROADCAST_BANDS:
        sizes = F.broadcast(sizes)
    rows = rows.join(sizes.select("band", "blocks"), "band").withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    rows = rows.withColumn("x", F.explode(meets)).select("band", "x.lo", "x.hi", "block", "doc_id", "fingerprint")
    rows = rows.repartition(shuffle_partitions(spark), "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "fingerprint")
    return rows.mapInArrow(_verify(least, bands, every), "a long, b long, near double")


def with_next(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, int]:
    """Rows of ``docs(doc_id, text)`` in descending doc_id, cut into ranges (``part``).

    Each range also holds, marked ``extra``, the first row of the range that follows
    it in that order, so the next document of every row is in its own partition and
    texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    points = sorted(set(base.select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    bounds = F.lit(0)
    if points:
        bounds = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p < F.col("key").cast("double"))) if len(points) <= 8 else _place(points)
    base = base.withColumn("part", bounds.cast("int"))
    # a row for each range: bounded by their number
    heads = base.groupBy("part").agg(F.max("key").alias("key")).orderBy(F.desc("part")).collect()
    carried = [(head.key, heads[i - 1].part) for i, head in enumerate(heads)]  # i = 0: the first goes to the last
    carry = F.broadcast(spark.createDataFrame(carried, "key long, goes int"))
    joined = base.join(carry, "key", "left")
    places = F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("extra")), F.when(F.col("goes").isNotNull(), F.struct(F.col("goes").alias("part"), F.lit(1).alias("extra")))))
    rows = joined.select("doc_id", "key", "text", F.explode(places).alias("at")).select("doc_id", "key", "text", "at.part", "at.extra")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "extra", F.desc("key"), "text"), parts


def _place(points: list[float]) -> Column:
    """How many of the sorted points are below the key, by halving."""
    if not points:
        return F.lit(0)
    mid = len(points) // 2
    return F.when(F.col("key").cast("double") > points[mid], mid + 1 + _place(points[mid + 1 :])).otherwise(_place(points[:mid]))


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half starts like the next document."""
    rows, _ = with_next(docs)

    def run(batches):
        walk = Walk()

        def report(ids, texts, following):
            edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
            made = walk.fingerprints([*texts, *edited, following[-1]])
            n = len(texts)
            prints, changed, after = made[:n], made[n : 2 * n], [*made[1:n], made[-1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(prints, pa.string()),
                    pa.array(changed, pa.string()),
                    pa.array(likeness_of(prints, changed)),
                    pa.array(likeness_of(prints, after)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        ids, texts, extra = [], [], False
        for batch in sliced(batches):
            for d, t, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("extra").to_pylist(), strict=True):
                if not extra:  # of several extra rows the first counts
                    ids.append(d)
                    texts.append(t)
                    extra = bool(x)
            if len(texts) > 1:
                yield report(ids[:-1], texts[:-1], texts[1:])
                ids, texts = ids[-1:], texts[-1:]

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
