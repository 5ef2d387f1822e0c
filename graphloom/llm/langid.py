"""Operator 7: language identification with hyperdimensional profiles.

Letters get random bipolar vectors; an n-gram of three letters binds them after
permuting by place (rotation by 2, 1, 0); a text or language bundles (adds) its
n-gram vectors.  A document's language is the prototype with the largest cosine.

Texts are never turned into vectors one by one: since a dot product is linear, a
document's product with a prototype is the sum of its distinct n-grams' products,
which are made once for the n-grams of a batch.  The document's own norm is taken as
that of quasi-orthogonal n-grams, ``sqrt(dim * sum(count ** 2))``; it is the same for
every language and so never changes the answer.

Letters of every script are lower-cased and have a vector each, made from a hash of the
code point; all other characters are one separator.  ``score`` is the cosine with that
norm, cut to 0..1.

Very long texts count whole; repeated rows count and are answered each by itself.
Null texts and texts without a letter are ``und`` with score 0; ties go to the
first language by name; without training rows all is ``und``.  Prototypes are
``dim`` numbers a language, summed on executors; only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import Texts, fold, sliced, widened

UNKNOWN = "und"
#: n-grams whose vectors are held at a time.
BLOCK = 4096


def letters() -> np.ndarray:
    """True at the code points of letters."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def letter_bits(points: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Bipolar vectors of code points, as bits (points, dim): a set bit is -1, and binding is exclusive or."""
    words = np.arange(-(-dim // 64), dtype=np.uint64)[None, :]
    drawn = fold(fold(points.astype(np.uint64), np.uint64([seed]))[:, None], words)
    return np.unpackbits(drawn.view(np.uint8), axis=1)[:, :dim]


def gram_blocks(grams: np.ndarray, dim: int, seed: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Vectors of n-grams (n, 3 code points), a block at a time."""
    points, place = np.unique(grams, return_inverse=True)
    place, bits = place.reshape(grams.shape), letter_bits(points, dim, seed)
    first, second = np.roll(bits, 2, 1), np.roll(bits, 1, 1)
    for lo in range(0, len(grams), BLOCK):
        at = slice(lo, min(lo + BLOCK, len(grams)))
        a, b, c = place[at].T
        bound = first[a]
        bound ^= second[b]
        bound ^= bits[c]
        yield at, 1.0 - 2.0 * bound.astype(np.float32)


def grams(texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (n, 3 code points); then for each n-gram of each text: its text, its n-gram, its count; texts with a letter.

    Runs of separators, which are code point 0, count as one.
    """
    # a final sigma is told from others by what follows, so no text may follow another
    each = [t.lower() for t in _strings(texts)]
    points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in each])]).astype(np.int64)
    points = np.where(table[points], points, 0)
    doc = np.repeat(np.arange(len(texts)), np.diff(offs))
    letter = np.zeros(len(texts), bool)
    letter[doc[points > 0]] = True
    # a separator after a separator of the same text is dropped
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] > 0) | (points[:-1] > 0) | (doc[1:] != doc[:-1])
    points, doc = points[keep], doc[keep]
    # letters of the batch by number, so that a text and its n-gram are one number
    seen = np.flatnonzero(np.bincount(points, minlength=1))
    number = np.zeros(int(points.max(initial=0)) + 1, np.uint64)
    number[seen] = np.arange(len(seen))
    code, base = number[points], np.uint64(max(len(seen), 1))
    whole = doc[2:] == doc[:-2]
    key = ((doc[2:].astype(np.uint64) * base + code[:-2]) * base + code[1:-1]) * base + code[2:]
    key, times = np.unique(key[whole], return_counts=True)
    of = (key // base**np.uint64(3)).astype(np.int64)
    distinct, gram = np.unique(key % base**np.uint64(3), return_inverse=True)
    parts = np.stack([distinct // base**np.uint64(i) % base for i in (2, 1, 0)], 1).astype(np.int64)
    return seen[parts] if len(seen) else np.zeros((0, 3), np.int64), of, gram, times, letter


def _strings(texts: Texts) -> list[str]:
    raw = texts.data.tobytes()
    return [raw[a:b].decode() for a, b in zip(texts.offs[:-1].tolist(), texts.offs[1:].tolist(), strict=True)]


def fit(train: DataFrame, dim: int = 1024, seed: int = 5) -> dict[str, np.ndarray]:
    """Prototype of each language of ``train(text, lang)``."""

    def partial(batches):
        table = letters()
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            lang = batch.column("lang").dictionary_encode()
            names = lang.dictionary.to_pylist()
            distinct, of, gram, times, _ = grams(Texts.of(batch.column("text")), table)
            row = lang.indices.to_numpy(zero_copy_only=False)[of]
            counts = np.bincount(row * len(distinct) + gram, times, len(names) * len(distinct)).reshape(len(names), -1)
            got = np.zeros((len(names), dim))
            for at, vectors in gram_blocks(distinct, dim, seed):
                got += counts[:, at] @ vectors
            for name, one in zip(names, got, strict=True):
                sums[name] = sums[name] + one if name in sums else one
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([r.tolist() for r in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])

    rows = train.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(partial, "lang string, bundle array<double>").select("lang", F.posexplode("bundle").alias("place", "value"))
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    bundles = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells"))
    return {r["lang"]: np.array([c["value"] for c in r["cells"]]) for r in bundles.orderBy("lang").collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = 1024, seed: int = 5) -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names; only ``text`` is an input."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    langs = sorted(prototypes)
    unit = np.array([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1.0) for x in langs], np.float32).reshape(len(langs), dim)

    def run(batches):
        table = letters()
        choice = pa.array([UNKNOWN, *langs])
        for batch in sliced(batches):
            n = batch.num_rows
            pick, score = np.zeros(n, np.int64), np.zeros(n)
            if langs:
                distinct, of, gram, times, letter = grams(Texts.of(batch.column("text")), table)
                weights = np.zeros((len(distinct), len(langs)), np.float32)
                for at, vectors in gram_blocks(distinct, dim, seed):
                    weights[at] = vectors @ unit.T
                dots = np.stack([np.bincount(of, weights[gram, i] * times, minlength=n) for i in range(len(langs))], 1)
                square = np.bincount(of, times.astype(float) ** 2, minlength=n)
                cosine = dots / np.sqrt(np.maximum(square, 1) * dim)[:, None]
                pick = np.where(letter, cosine.argmax(1) + 1, 0)
                score = np.where(letter, np.clip(cosine.max(1), 0, 1), 0.0)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pc.take(choice, pa.array(pick)), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, widened(docs, "lang_pred string, score double"))
