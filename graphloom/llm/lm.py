"""Operator 4: hierarchical Pitman-Yor language model.

Restaurants: one per context below one shared root; the root's base is uniform over
the vocabulary and one unseen word.  A context is the word before (its 32-bit hash; 0
at the start of a text), so restaurants grow with the vocabulary.  A customer is a
training token; a table of a context restaurant is a customer of the root.

Seating is kept as tables per dish, and Gibbs sweeps draw the number of tables of
each dish given all others: ``p(t) ~ S_d(c, t) * (theta + d T) ** t * P(w) ** t`` with
generalised Stirling numbers S for up to ``EXACT`` customers; larger dishes seat the
customers beyond that in blocks by the restaurant process itself, the expected number
of new tables rounded at random.  ``chains`` samplers run side by side for ``sweeps``
sweeps; predictive probabilities are averaged over their last seatings.

Words are hashed to slices; a task holds all customers and queries of its words, so
seating is local.  Totals of a restaurant are spread over slices: after every sweep
each slice sends its sums by context to buckets of contexts, which add them and answer
each slice in the order it asked.  A sweep draws from the totals after the sweep
before, and each draw from a hash of its word, context, chain and sweep, so scores do
not depend on the number of slices (but for the rounding of sums).  Nothing but plans
passes through the driver.  Tokens travel once, as packed blobs, to a table in the
shared folder; each pass reads it and repeats the seatings before from the answers.
Sums of a text come back by the slice of input it is in.

Very long texts are cut into tokens whole, in slices of documents, and scored by sums;
null and empty texts are one end token; repeated rows count and score each by itself;
without training rows every probability is 1 / (V + 1) with V = 0; a null doc_id trains
(its remainder is taken as not held out); an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import Texts, fold, give_back, mix, sliced
from graphloom.session import cut, discard, shared_dir, shuffle_partitions

END = np.uint64(0x5BD1E9955BD1E995)
EXACT = 300
#: Bytes of text whose tokens travel together: each of their words is named once.
BLOB_BYTES = 8 << 20
BLOB = "p int, slice long, kind int, data binary"
ANSWER = "p int, round int, q int, data binary"


def pack_arrays(*arrays: np.ndarray) -> bytes:
    raw = b"".join(len(b := a.tobytes()).to_bytes(4, "little") + b for a in arrays)
    return pa.compress(raw, codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def planes(x: np.ndarray) -> np.ndarray:
    """The lowest bytes of all numbers, then the next ones: high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)


def unplanes(raw: np.ndarray, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack_planes(*arrays: np.ndarray) -> bytes:
    return pack_arrays(*(planes(a) for a in arrays))


def unpack_planes(data: bytes, kinds: list) -> list[np.ndarray]:
    return [unplanes(raw, kind) for raw, kind in zip(unpack_arrays(data, [np.uint8] * len(kinds)), kinds, strict=True)]


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers; ``np.cumsum`` undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def unpack_arrays(data: bytes, kinds: list) -> list[np.ndarray]:
    raw = pa.decompress(data[:-8], int.from_bytes(data[-8:], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 4))
        at += 4 + n
    return out


def is_held(doc_id: int | None, folds: int, held: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == held


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context, text) of each token, the end tokens included."""
    words, first = texts.lowered().word_hashes()
    tokens = np.insert(words, first[1:], END)
    sizes = np.diff(first) + 1
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
    context = np.zeros(len(tokens), np.uint32)
    context[1:] = np.maximum(mix(tokens[:-1]) >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    context[np.cumsum(sizes) - sizes] = 0
    return tokens, context, doc


def edges_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def runs_of(edges: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(edges, n)).astype(np.uint32)


def _blobs(places: list[int], folds: int, held: int):
    slices = len(places)

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in sliced(batches, most=BLOB_BYTES):
            ids = batch.column("doc_id").to_pylist()
            train = np.array([not is_held(d, folds, held) for d in ids])
            tokens, context, doc = tokens_of(Texts.of(batch.column("text")))
            sizes = np.bincount(doc, minlength=len(ids)).astype(np.int64)
            order = np.lexsort((context, tokens))
            tokens, context, doc = tokens[order], context[order], doc[order]
            # the slice number grows with the hash
            slice_of = ((tokens >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(slice_of, np.arange(slices + 1))
            key = base | number
            number += 1
            rows = [(places[key % slices], 1, pack_arrays(np.array([d is not None for d in ids]), np.array([d or 0 for d in ids], np.int64), train, sizes))]
            bits = np.packbits(train)
            for p, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if hi > lo:
                    t, c = tokens[lo:hi], context[lo:hi]
                    kind = edges_of(t, c)
                    word = edges_of(t[kind])
                    there, at = np.unique(c[kind], return_inverse=True)
                    data = pack_planes(gaps(t[kind][word]), runs_of(word, len(kind)), runs_of(kind, len(t)), gaps(there), at.astype(np.uint32), doc[lo:hi], bits)
                    rows.append((places[p], 0, data))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([key] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["p", "slice", "kind", "data"])

    return run


class Slice:
    """All tokens of the words of one slice.

    A kind is a (word, context) of any token, with the count ``c`` of its training tokens.
    """

    def __init__(self, rows: pa.Table):
        self.heads, self.keys, blobs = [], [], []
        for key, kind, data in zip(*(rows.column(c).to_pylist() for c in ("slice", "kind", "data")), strict=True):
            if kind:
                self.heads.append((key, data))
            else:
                self.keys.append(key)
                blobs.append(unpack_planes(data, [np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8]))
        self.of = [len(b[5]) for b in blobs]
        if not blobs:
            return
        self.words, place = np.unique(np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blobs]), return_inverse=True)
        word = np.repeat(place, np.concatenate([b[1] for b in blobs]))
        self.contexts, place = np.unique(np.concatenate([np.cumsum(b[3], dtype=np.uint32)[b[4]] for b in blobs]), return_inverse=True)
        kinds, place = np.unique(word * len(self.contexts) + place, return_inverse=True)
        self.word, self.context = kinds // len(self.contexts), kinds % len(self.contexts)
        #: the kind and the text of each token
        self.kind = np.repeat(place.astype(np.int32), np.concatenate([b[2] for b in blobs]))
        self.doc = np.concatenate([b[5] for b in blobs])
        train = np.concatenate([np.unpackbits(b[6])[b[5]] for b in blobs]).astype(bool)
        self.c = np.bincount(self.kind[train], minlength=len(kinds))
        self.n = self.by_word(self.c)

    def by_word(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, value, len(self.words)).astype(np.int64)

    def by_context(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, value, len(self.contexts)).astype(np.int64)


def stirling(d: float, most: int) -> np.ndarray:
    """log S_d(c, t) for c, t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - d * t, 1e-300))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def chance(h: np.ndarray, step: int = 0) -> np.ndarray:
    """A number in [0, 1) from each hash."""
    return (mix(h + np.uint64(step)) >> np.uint64(11)) * 2.0**-53


def draw_tables(c: np.ndarray, strength: np.ndarray, d: float, table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers; strength is (theta + d T) * P(w); ``h`` holds a hash for each draw."""
    t = np.minimum(c, 1).astype(np.int64)
    several = np.flatnonzero(c > 1)
    order = several[np.argsort(np.minimum(c[several], EXACT), kind="stable")]
    sizes, lengths = np.unique(np.minimum(c[order], EXACT), return_counts=True)
    ends = np.cumsum(lengths)
    for size, lo, hi in zip(sizes.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
        step = max(1, 2_000_000 // size)
        for at in range(lo, hi, step):
            rows = order[at : min(hi, at + step)]
            weight = table[size, 1 : size + 1][None, :] + np.log(strength[rows])[:, None] * np.arange(1, size + 1)[None, :]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            t[rows] = 1 + (weight < chance(h[rows])[:, None] * weight[:, -1:]).sum(1)
    more = np.flatnonzero(c > EXACT)
    seated, step = np.full(len(more), EXACT, np.int64), 0
    while len(more):
        step += 1
        block = np.minimum(c[more] - seated, np.maximum(1, seated // 20))
        fresh = np.minimum(strength[more] / (strength[more] + np.maximum(seated - d * t[more], 1e-9)), 1.0)
        t[more] += (block * fresh + chance(h[more], step)).astype(np.int64)
        seated += block
        on = seated < c[more]
        more, seated = more[on], seated[on]
    return t


def discount(one: int, two: int) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def counts(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """What a slice sends first: customers and dishes by context; its sums."""
    width = part.by_word(part.c > 0)
    sums = [(part.n > 0).sum(), part.n.sum(), (part.c > 0).sum(), *((x == i).sum() for x in (part.c, width) for i in (1, 2))]
    return np.stack([part.by_context(part.c), part.by_context(part.c > 0)]), np.array(sums, np.int64)


class Seating:
    """The samplers of one slice.  ``first`` is the answer to its ``counts``."""

    def __init__(self, part: Slice, first: tuple[np.ndarray, np.ndarray], theta: float, chains: int, seed: int):
        self.part, self.theta, self.chains, self.seed, self.sweep = part, theta, chains, seed, 0
        (self.customers, dishes), (self.vocabulary, self.n, kinds, one, two, wide1, wide2) = first[0], first[1].tolist()
        self.d, self.d0 = discount(one, two), discount(wide1, wide2)
        self.uniform = 1.0 / (self.vocabulary + 1)
        # all customers of a dish at one table
        self.seats = [((part.c > 0).astype(np.int64), part.by_word(part.c > 0), (part.n > 0).astype(np.int64))] * chains
        self.per_context, self.all = [dishes] * chains, [(kinds, self.vocabulary)] * chains
        self.hash = fold(part.words[part.word], part.contexts[part.context].astype(np.uint64))
        self.tables = stirling(self.d, EXACT), stirling(self.d0, EXACT)

    def draw(self) -> tuple[np.ndarray, np.ndarray]:
        """One sweep: tables by context of each chain; tables of all contexts and of the root."""
        part = self.part
        self.sweep += 1
        for k in range(self.chains):
            salt = np.uint64([(self.seed * 1000 + self.sweep) * 1000 + k])
            rest = (self.theta + self.d0 * self.all[k][1]) * self.uniform
            strength = np.maximum((self.theta + self.d * self.per_context[k][part.context]) * self.base(k)[part.word], 1e-300)
            tables = draw_tables(part.c, strength, self.d, self.tables[0], fold(self.hash, salt))
            root = part.by_word(tables)
            self.seats[k] = (tables, root, draw_tables(root, np.full(len(root), rest), self.d0, self.tables[1], fold(part.words, salt)))
        values = np.stack([part.by_context(tables) for tables, _, _ in self.seats])
        return values, np.array([x.sum() for _, root, tables0 in self.seats for x in (root, tables0)], np.int64)

    def take(self, answer: tuple[np.ndarray, np.ndarray]) -> None:
        """The totals of all slices after a sweep."""
        self.per_context = list(answer[0])
        self.all = [tuple(x) for x in answer[1].reshape(self.chains, 2).tolist()]

    def base(self, k: int) -> np.ndarray:
        """The root's probability of each word of the slice."""
        _, root, tables0 = self.seats[k]
        customers, total0 = self.all[k]
        return (root - self.d0 * tables0 + (self.theta + self.d0 * total0) * self.uniform) / (self.theta + customers)

    def probability(self) -> np.ndarray:
        """Of each kind, averaged over the chains."""
        part, mean = self.part, np.zeros(len(self.part.c))
        for k in range(self.chains):
            p = (self.theta + self.d * self.per_context[k][part.context]) * self.base(k)[part.word]
            mean += (p + part.c - self.d * self.seats[k][0]) / (self.theta + self.customers[part.context])
        return mean / self.chains


def values_sent(number: int, sums: np.ndarray) -> int:
    """Values by context in a round: two at first, then one a chain, which has two sums."""
    return len(sums) // 2 if number else 2


def _answers(rows: pa.Table, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The answers of each round: (values by context of the slice, sums of all slices)."""
    rounds: dict[int, dict[int, list]] = {}
    for number, q, data in zip(*(rows.column(c).to_pylist() for c in ("round", "q", "data")), strict=True):
        rounds.setdefault(number, {})[q] = data
    out = []
    for number in sorted(rounds):
        got = [unpack_planes(rounds[number][q], [np.int64, np.int64]) for q in range(buckets)]
        width = values_sent(number, got[0][0])
        out.append((np.concatenate([values.reshape(width, -1) for _, values in got], 1), got[0][0]))
    return out


def bucket_edges(contexts: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(contexts.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def _ask(buckets: int, theta: float, chains: int, seed: int):
    """(q, p, data): what a slice tells each bucket of contexts after a sweep."""

    def run(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        part = Slice(blobs)
        rows = []
        if part.of:
            got = _answers(answers, buckets)
            if got:
                seating = Seating(part, got[0], theta, chains, seed)
                for answer in got[1:]:
                    seating.draw()
                    seating.take(answer)
                values, sums = seating.draw()
            else:
                values, sums = counts(part)
            edges = bucket_edges(part.contexts, buckets)
            rows = [pack_planes(sums, gaps(part.contexts[lo:hi]), np.ascontiguousarray(values[:, lo:hi]).reshape(-1)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        give_back()
        p = blobs.column("p")[0].as_py() if rows else 0
        return pa.table({"q": pa.array(range(len(rows)), pa.int32()), "p": pa.array([p] * len(rows), pa.int32()), "data": pa.array(rows, pa.binary())})

    return run


def _add(number: int):
    """(p, round, q, data): the sums of a bucket of contexts for each slice, in the order it asked."""

    def run(rows: pa.Table) -> pa.Table:
        got = [unpack_planes(data, [np.int64, np.uint32, np.int64]) for data in rows.column("data").to_pylist()]
        totals = np.sum([g[0] for g in got], 0)
        lengths = [len(g[1]) for g in got]
        contexts, place = np.unique(np.concatenate([np.cumsum(g[1], dtype=np.uint32) for g in got]), return_inverse=True)
        width = values_sent(number, totals)
        values = np.concatenate([g[2].reshape(width, -1) for g in got], 1)
        sums = np.stack([np.bincount(place, v, len(contexts)).astype(np.int64) for v in values])
        ends = np.cumsum(lengths)
        data = [pack_planes(totals, np.ascontiguousarray(sums[:, place[e - n : e]]).reshape(-1)) for e, n in zip(ends.tolist(), lengths, strict=True)]
        n = len(data)
        return pa.table({"p": rows.column("p"), "round": pa.array([number] * n, pa.int32()), "q": rows.column("q"), "data": pa.array(data, pa.binary())})

    return run


def _scores(buckets: int, theta: float, chains: int, seed: int):
    """(slice, kind, data): sums of each text over the words of this slice.

    Sums of the score travel as single floats and are added as doubles.
    """

    def run(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        part = Slice(blobs)
        rows = [(key, 1, data) for key, data in part.heads]
        if part.of:
            first, *later = _answers(answers, buckets)
            seating = Seating(part, first, theta, chains, seed)
            for answer in later:
                seating.draw()
                seating.take(answer)
            logs, count = np.log10(seating.probability()), np.log10(part.n + 1.0)
            world = np.array([seating.n, seating.vocabulary], np.int64)
            lo = 0
            for key, size in zip(part.keys, part.of, strict=True):
                doc, kind = part.doc[lo : lo + size], part.kind[lo : lo + size]
                lo += size
                word = part.word[kind]
                sums = [np.bincount(doc, logs[kind]), np.bincount(doc, count[word]), np.bincount(doc, part.n[word] > 0)]
                some = np.unique(doc).astype(np.int32)
                rows.append((key, 0, pack_arrays(some, sums[0][some].astype(np.float32), sums[1][some], sums[2][some].astype(np.int32), world)))
        give_back()
        return pa.table({"slice": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _texts():
    """One row per text of a slice of input."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_pylist()
        data = rows.column("data").to_pylist()
        there, ids, train, n = unpack_arrays(data[kind.index(1)], [bool, np.int64, bool, np.int64])
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        # in one order whatever the shuffle gave
        for blob in sorted(x for x, k in zip(data, kind, strict=True) if not k):
            some, s, b, m, (trained, vocabulary) = unpack_arrays(blob, [np.int32, np.float32, np.float64, np.int32, np.int64])
            score[some] += s
            base[some] += b
            known[some] += m
        base -= n * np.log10(trained + vocabulary + 1.0)
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=~there), "held_out": ~train, "n_tokens": n, "n_known": known,
                "train_tokens": np.full(len(ids), trained, np.int64), "base_score": base, "score": score,
            }
        )

    return run


def slice_places(spark: SparkSession, slices: int) -> list[int]:
    """One number for each partition that hash partitioning puts there, so that slices spread evenly.

    Where none is found the slice shares a partition with another.
    """
    number = F.col("id").cast("int")
    tried = spark.range(slices * 24).select(number.alias("x"), F.pmod(F.hash(number), F.lit(slices)).alias("at"))
    found = {r["at"]: r["x"] for r in tried.groupBy("at").agg(F.min("x").alias("x")).collect()}
    spare = iter(range(slices * 24, slices * 25))
    return [found[i] if i in found else next(spare) for i in range(slices)]


def score_documents(docs: DataFrame, chains: int = 2, sweeps: int = 2, folds: int = 7, held: int = 2, theta: float = 1.0, seed: int = 11, slices: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs(doc_id, text)``.

    Learns from the documents whose crc32(doc_id as text) mod ``folds`` is not ``held``.
    ``slices`` of the vocabulary (the session's shuffle partitions if None) change nothing but rounding.
    """
    spark = docs.sparkSession
    slices = slices or shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    root, name = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", f"tokens_{uuid.uuid4().hex}"
    dealt = rows.mapInArrow(_blobs(slice_places(spark, slices), folds, held), BLOB).repartition(slices, "p")
    # buckets are the partitions: passes read them without a shuffle of their own
    dealt.write.bucketBy(slices, "p").option("path", root).saveAsTable(name)
    blobs = spark.table(name)
    answers = spark.createDataFrame([], ANSWER)
    for number in range(sweeps + 1):
        asked = blobs.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(_ask(slices, theta, chains, seed), "q int, p int, data binary")
        answers = answers.unionAll(cut(asked.groupBy("q").applyInArrow(_add(number), ANSWER)))
    parts = blobs.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(_scores(slices, theta, chains, seed), "slice long, kind int, data binary")
    scores = cut(parts.groupBy("slice").applyInArrow(_texts(), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    spark.sql(f"DROP TABLE {name}")
    discard(spark, root)
    return scores
