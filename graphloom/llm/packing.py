"""Operator 2: cost-balanced packing of documents into token sequences.

Each task encodes its documents once and packs them in blocks of about
``block_tokens`` ids.  Within a block, runs of ``capacity`` ids fill a sequence
alone; the rest goes, longest first, to the sequence with the lowest estimated
cost (``linear * n + quadratic * n * n`` per piece, attention staying within a
piece) that still has room, cut where the room ends.  A block opens
``ceil(ids / capacity)`` sequences, so its padding is under one sequence,
and memory is bounded by the block, or by one longer document.  Nothing is shuffled: a
lost task is redone from its input split with the same result.  Of equal lengths the
earlier row goes first, of equal costs the earlier sequence takes it.

Nulls and empty texts are documents of the end id alone; repeated rows and
repeated doc_ids are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import Encoder
from graphloom.llm.text import Texts, sliced

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
#: Bytes of text that are encoded at a time: a byte takes some 25 bytes of arrays meanwhile.
ENCODED_BYTES = 1 << 20
#: Sequence numbers of one task, as bits.
TASK_BITS = 36


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block; sequences count from 0."""
    pieces, rest = [], []
    bins = 0
    for doc, n in enumerate(lengths.tolist()):
        at = 0
        while n - at >= capacity:
            pieces.append((doc, at, capacity, bins, 0))
            bins += 1
            at += capacity
        if n > at:
            rest.append((n - at, doc, at))
    rest.sort(key=lambda x: (-x[0], x[1]))
    count = -(-sum(n for n, _, _ in rest) // capacity)
    room = [capacity] * count
    heap = [(0.0, b) for b in range(count)]  # cost, sequence
    for n, doc, at in rest:
        while n:
            cost, b = heapq.heappop(heap)
            aside = []
            if room[b] < n:  # a few of the next cheapest may have room for all of it
                for _ in range(min(4, len(heap))):
                    other = heapq.heappop(heap)
                    aside.append(other)
                    if room[other[1]] >= n:
                        aside[-1] = (cost, b)
                        cost, b = other
                        break
            take = min(n, room[b])
            pieces.append((doc, at, take, bins + b, capacity - room[b]))
            room[b] -= take
            n, at = n - take, at + take
            if room[b]:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, b))
            for x in aside:
                heapq.heappush(heap, x)
    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """One row per piece of each document of ``docs(doc_id, text)``."""

    def run(batches):
        encoder = Encoder(tokenizer)
        base = TaskContext.get().partitionId() << TASK_BITS
        opened, held, size = 0, [], 0

        def flush():
            nonlocal opened
            ids = np.concatenate([x[1] for x in held])
            doc_ids = [d for x in held for d in x[0]]
            lengths = np.concatenate([x[2] for x in held])
            first = np.concatenate([[0], np.cumsum(lengths)])
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            doc, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*assign(lengths, capacity, linear, quadratic), strict=True))
            at = first[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(lengths[doc]),
                    pa.array(base + opened + seq),
                    pa.array(offset),
                    pa.array(linear * length + quadratic * length.astype(float) ** 2),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"],
            )
            opened += int(seq.max()) + 1
            return out

        for batch in sliced(batches):
            for part in sliced([batch], most=ENCODED_BYTES):
                ids, first = encoder.encode(Texts.of(part.column("text")))
                # the end id goes after each document
                whole = np.insert(ids, first[1:], np.uint32(end_id))
                held.append((part.column("doc_id").to_pylist(), whole, np.diff(first) + 1))
                size += len(whole)
            if size >= block_tokens:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
