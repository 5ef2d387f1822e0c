"""Vectorised text kernels on the bytes of Arrow string columns.

Every kernel takes whole texts; ``Texts`` holds one Arrow batch as a flat byte
array with offsets, nulls read as empty.  Words are runs of bytes outside
``[\\x20\\x09-\\x0D]``; these are single bytes in UTF-8, so byte scans are exact.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKS = b" \t\n\v\f\r"
#: Bytes of text that a kernel takes at a time; longer single texts are still whole.
SLICE_BYTES = 4 << 20

#: Bytes of text after which freed memory is given back.
GIVE_BACK_BYTES = 16 << 20


class Texts:
    """One batch: ``data`` (uint8), ``offs`` (int64, n + 1)."""

    __slots__ = ("data", "offs")

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string())
        if column.null_count:
            column = pc.fill_null(column, "")
        n = len(column)
        if not n:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, offs, data = column.buffers()
        offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(raw[offs[0] : offs[-1]], offs - offs[0])

    @classmethod
    def of_bytes(cls, column: pa.Array) -> Texts:
        """A large_binary column without nulls."""
        n = len(column)
        _, offs, data = column.buffers()
        offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(raw[offs[0] : offs[-1]], offs - offs[0])

    def __len__(self) -> int:
        return len(self.offs) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offs)

    def word_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends, first word of each text (n + 1), mask of word bytes."""
        word = ~SPACE[self.data]
        n = len(word)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offs), np.int64), word
        full = self.offs[1:] > self.offs[:-1]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = word[:-1]
        before[self.offs[:-1][full]] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = word[1:]
        after[self.offs[1:][full] - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offs), word

    def words(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Index of each word in the batch's dictionary, that dictionary (binary), first word of each text."""
        starts, ends, first, word = self.word_spans()
        index, uniq = dictionary(self.data[word], ends - starts)
        return index, uniq, first

    def word_hashes(self, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each word, first word of each text."""
        index, uniq, first = self.words()
        return hash_each(uniq, seed)[index], first

    def codepoint_offsets(self) -> np.ndarray:
        """Code points before each text (n + 1)."""
        lead = (self.data & 0xC0) != 0x80
        total = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
        return total[self.offs]


def dictionary(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary-encode the consecutive pieces of ``data``."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    pieces = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_each(uniq: pa.Array, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in uniq.to_pylist()), np.uint64, len(uniq))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes; the order matters."""
    return mix(x * np.uint64(0x9E3779B97F4A7C15) + y + np.uint64(0x632BE59BD9B4E019))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word runs; fewer words are one run."""
    runs = None
    if len(hashes) >= k:
        n = len(hashes) - k + 1
        runs = hashes[:n]
        for i in range(1, k):
            runs = fold(runs, hashes[i : n + i])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            one = np.uint64([b - a])
            for h in hashes[a:b]:
                one = fold(one, np.uint64([h]))
            yield one
        else:
            yield np.zeros(0, np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps Python workers from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def sliced(batches, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about ``most`` bytes of text; memory is given back at their end."""
    since = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            since += int(size[to - 1] - (size[at - 1] if at else 0))
            if since >= GIVE_BACK_BYTES:
                give_back()
                since = 0
            at = to
    give_back()


def widened(docs: DataFrame, added: str) -> StructType:
    """The schema of ``docs`` with the columns of the DDL text ``added``."""
    return StructType([*docs.schema.fields, *StructType.fromDDL(added).fields])
