"""Operator 8: quality rules by a calibrated logistic regression on hashed n-grams.

Features of a text are hashed words and hashed runs of four bytes, as frequencies
(square roots of shares), in ``2 ** BITS`` cells.  The model is fitted on at most
``sample`` labelled rows, taken in the order of a hash of doc_id; a fifth of them is
set aside to calibrate the probability (Platt).  Texts are scored in Arrow batches
and kept at a calibrated probability of at least ``threshold``.  Beside the model
two fixed rules (``base_failed``) reject texts of under 50 words and texts of which
over half the words stand in repeated three-word windows.

Very long texts are judged whole; repeated rows are judged each by itself.
Null texts have no words and fail; ties at the threshold are kept; without labelled
rows of both kinds the model keeps everything that the rules keep; repeated labels of
a document count once each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import SPACE, Texts, dictionary, fold, hash_each, mix, sliced, widened

BITS = 16
#: Bytes of text whose features are made at a time: a byte takes some 50 bytes of them.
FEATURE_BYTES = 1 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def signals(texts: Texts) -> dict[str, np.ndarray]:
    """The counts that the fixed rules use, of each text."""
    n = len(texts)
    data, offs = texts.data, texts.offs
    hashes, first = texts.word_hashes()
    n_words = np.diff(first)
    per_byte = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[offs])
    lead = (data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": per_byte(lead & ~SPACE[data]), "n_symbols": per_byte(SYMBOLS[data])}

    repeat = np.zeros(n, np.int64)
    if len(hashes) >= 3:
        doc = np.repeat(np.arange(n), n_words)
        window = fold(fold(hashes[:-2], hashes[1:-1]), hashes[2:])
        whole = doc[2:] == doc[:-2]
        at = np.flatnonzero(whole)
        key = fold(window[at], doc[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        mark = np.zeros(len(hashes), bool)
        for i in range(3):
            mark[at[again] + i] = True
        repeat = np.bincount(doc[mark], minlength=n)
    out["n_repeat_words"] = repeat

    dup = np.zeros(n, np.int64)
    if len(data):
        full = offs[1:] > offs[:-1]
        end = data == 0x0A
        start = np.zeros(len(data) + 1, bool)
        start[1:] = end
        start[offs[:-1][full]] = True
        starts = np.flatnonzero(start[:-1])
        lengths = np.diff(np.append(starts, len(data)))
        visible = np.add.reduceat(~SPACE[data], starts) > 0
        # a line keeps its newline here, the last one of a text has none
        last = starts + lengths
        ends_here = data[np.maximum(last - 1, 0)] == 0x0A
        body = np.ones(len(data), bool)
        body[last[ends_here] - 1] = False
        index, uniq = dictionary(data[body], lengths - ends_here)
        doc = np.searchsorted(offs, starts, "right") - 1
        key = doc.astype(np.int64) * (len(uniq) + 1) + index
        _, firsts = np.unique(key, return_index=True)
        later = np.ones(len(key), bool)
        later[firsts] = False
        dup = np.bincount(doc[later & visible], minlength=n)
    out["n_dup_lines"] = dup
    return out


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of each hashed word and each run of four bytes."""
    index, uniq, first = texts.lowered().words()
    words = (mix(hash_each(uniq)) >> np.uint64(64 - BITS)).astype(np.int32)[index] if len(index) else np.zeros(0, np.int32)
    docs = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    data = texts.data
    if len(data) < 4:
        return words, docs
    four = data[:-3].astype(np.uint32)
    for i in (1, 2, 3):
        four = four << np.uint32(8) | data[i : len(data) - 3 + i]
    cell = ((four * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(texts.offs))
    whole = doc[3:] == doc[:-3]
    return np.concatenate([words, cell[whole]]), np.concatenate([docs, doc[3:][whole]])


def _sparse(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, value) of distinct cells."""
    cell, doc = features(texts)
    key = np.sort(doc.astype(np.int64) << BITS | cell)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(edge, len(key))).astype(float)
    doc = key[edge] >> BITS
    share = times / np.maximum(np.bincount(doc, times, minlength=len(texts)), 1)[doc]
    return doc, (key[edge] & ((1 << BITS) - 1)).astype(np.int32), np.sqrt(share)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, epochs: int = 12, rate: float = 2.0, decay: float = 1e-5, seed: int = 3) -> tuple[np.ndarray, float, float]:
    """(weights with the bias last, Platt slope, Platt offset) from ``labels(doc_id, quality)``."""
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # the sample is bounded by ``sample`` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in sliced(batches, most=FEATURE_BYTES):
            doc, cell, value = _sparse(Texts.of(batch.column("text")))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("quality"),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(cell)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(value.astype(np.float32))),
                ],
                ["doc_id", "quality", "cells", "shares"],
            )

    got = rows.mapInArrow(run, "doc_id long, quality int, cells array<int>, shares array<float>").toArrow().combine_chunks()
    got = got.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    y = (got.column("quality").to_numpy() > 0).astype(float)
    weights = np.zeros((1 << BITS) + 1)
    if len(y) == 0 or y.min() == y.max():
        weights[-1] = 1.0
        return weights, 1.0, 0.0
    cells = [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in got.column("cells")]
    shares = [np.asarray(x.values.to_numpy(zero_copy_only=False), float) for x in got.column("shares")]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, train = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
    # both kinds weigh the same
    balance = np.where(y > 0, 0.5 / max(y[train].mean(), 1e-9), 0.5 / max(1 - y[train].mean(), 1e-9))
    squares = np.full(len(weights), 1e-6)
    for epoch in range(epochs):
        for i in rng.permutation(train):
            c, v = cells[i], shares[i]
            z = float(weights[c] @ v) + weights[-1]
            g = balance[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
            gc = g * v + decay * weights[c]
            squares[c] += gc * gc
            weights[c] -= rate / (1 + epoch) ** 0.5 * gc / np.sqrt(squares[c])
            squares[-1] += g * g
            weights[-1] -= 0.1 * g / np.sqrt(squares[-1])
    z = np.array([weights[cells[i]] @ shares[i] + weights[-1] for i in held])
    a, b = 1.0, 0.0
    t = np.where(y[held] > 0, (y[held].sum() + 1) / (y[held].sum() + 2), 1 / ((1 - y[held]).sum() + 2))
    scale = max(z.std(), 1e-9)
    z = z / scale
    for _ in range(200):  # Newton steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, w = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[w @ (z * z) + 1e-3, w @ z], [w @ z, w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([d @ z + 1e-3 * (a - 1), d.sum() + 1e-3 * b]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return weights, a / scale, b


def judge(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = 0.5, least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """``docs`` with the signals, quality_prob, base_failed and kept, which replace columns of these names."""
    added = [*SIGNALS, "quality_prob", "base_failed", "kept"]
    docs = docs.drop(*added)
    names = docs.columns
    weights, slope, offset = model
    weights32 = weights.astype(np.float32)

    def run(batches):
        for batch in sliced(batches, most=FEATURE_BYTES):
            texts = Texts.of(batch.column("text").cast(pa.string()))
            n = batch.num_rows
            found = signals(texts)
            doc, cell, value = _sparse(texts)
            z = np.bincount(doc, weights32[cell] * value, minlength=n) + weights[-1]
            prob = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
            failed = (found["n_words"] < least_words) | (100 * found["n_repeat_words"] > repeat_percent * found["n_words"])
            kept = ~failed & (prob >= threshold)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[s].astype(np.int64)) for s in SIGNALS), pa.array(prob), pa.array(failed), pa.array(kept)], [*names, *added])

    longs = ", ".join(f"{s} long" for s in SIGNALS)
    return docs.mapInArrow(run, widened(docs, f"{longs}, quality_prob double, base_failed boolean, kept boolean"))
