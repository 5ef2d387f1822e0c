"""Operator 13: SentencePiece encoding and decoding through a table of distinct chunks.

A model whose pieces never hold a whitespace marker after another character cannot
merge across the start of a marked word, so a text may be cut there: a chunk is a run
of markers and what follows them.  Texts are taken in slices.  A slice sends its
distinct chunks once, numbered by frequency, to the buckets of the table of distinct
chunks, and each document as its chunks' numbers.  A bucket segments each of its
chunks once; the ids go back to the slices that hold the chunk, where they take the
numbers' places.  Buckets are chosen by hash, so a task's share of the table falls
with the number of shuffle partitions.

Only models with identity normalisation, a dummy prefix, kept white space and without
pieces that cross a marker are cut like this; others are refused.  Markers in a text
count as spaces, as in the library.

Null and empty texts have no ids; very long texts, and texts without a space, are one
document and one chunk like any other; repeated rows stay; columns of any name are
kept, but ``ids`` replaces one of that name and ``text`` goes (decoding gives it back);
an empty table gives no rows.  A slice is named by a hash of its texts, so a table that
is read in another order the second time raises an error: cut such a table first.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.bpe import resolve
from graphloom.llm.text import Texts, dictionary, hash_each, ragged, sliced, widened
from graphloom.session import shuffle_partitions

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Bytes of text in a slice; ids in a batch that is given back.
SLICE, BATCH_IDS = 16 << 20, 1 << 20
#: Chunks that a bucket's table holds; one that outgrows this starts anew, and may segment a chunk twice.
REMEMBERED = 2_000_000
UNSTABLE = "a slice lacks chunks: the table was read in another order; cut it first"


def processor(model: str):
    """The library's processor of a model file, which must be one that may be cut at markers."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=resolve(model))
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing or sp.normalize("Ａ  b ") != f"{MARK}Ａ{MARK * 2}b{MARK}":
        raise ValueError(f"{model} cannot be cut at white space markers")
    return sp


def chunks(texts: Texts) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each chunk in the slice's dictionary, the dictionary by falling frequency, first chunk of each text.

    A chunk is written without its first marker; spaces stand for markers.
    """
    data, offs = texts.data, texts.offs
    head = np.zeros(len(data), bool)
    head[offs[:-1][offs[1:] > offs[:-1]]] = True
    space = data == 0x20
    mark = space & ~head
    mark[1:] &= ~space[:-1]
    starts = np.flatnonzero(head | mark)
    lengths = np.diff(np.append(starts, len(data))) - mark[starts]
    index, uniq = dictionary(data[~mark], lengths)
    order = np.argsort(-np.bincount(index, minlength=len(uniq)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[index], pc.take(uniq, pa.array(order)), np.searchsorted(starts, offs)


def numbers_to_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, lowest first, the last byte's high bit clear; and how many bytes each takes."""
    width = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    place = ragged(np.zeros(len(width), np.int64), width)
    value = np.repeat(numbers, width) >> 7 * place & 127
    return (value | np.where(place + 1 < np.repeat(width, width), 128, 0)).astype(np.uint8), width


def bytes_to_numbers(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    last = data < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


def _slices(batches):
    """Texts of each slice, its name and its batch."""
    for batch in sliced(batches, most=SLICE):
        column = pc.replace_substring(pc.fill_null(batch.column("text"), ""), MARK, " ")
        texts = Texts.of(column)
        name = xxhash.xxh3_128(texts.data)
        name.update(texts.offs)
        yield texts, name.digest(), batch


def _packed(data, lengths: np.ndarray) -> bytes:
    """Lengths and data of several strings, compressed."""
    widths = numbers_to_bytes(lengths)[0].tobytes()
    return zstandard.compress(len(widths).to_bytes(8, "little") + widths + bytes(data), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(blob)
    at = 8 + int.from_bytes(raw[:8], "little")
    return bytes_to_numbers(np.frombuffer(raw, np.uint8)[8:at]), raw[at:]


def _dictionaries(buckets: int):
    """A row for each slice and bucket of chunks: the numbers of the chunks, as steps, and the chunks."""

    def run(batches):
        for texts, name, _ in _slices(batches):
            uniq = chunks(texts)[1]
            bucket = (hash_each(uniq) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            held = Texts.of_bytes(pc.take(uniq, pa.array(order)).cast(pa.large_binary()))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[b], edges[b + 1]
                steps = numbers_to_bytes(np.diff(order[lo:hi], prepend=-1) - 1)[0].tobytes()
                rows.append((name, b, steps, _packed(held.data[held.offs[lo] : held.offs[hi]], np.diff(held.offs[lo : hi + 1]))))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "bucket", "steps", "held"])

    return run


def _numbered(batches):
    for texts, name, batch in _slices(batches):
        index, _, first = chunks(texts)
        data, width = numbers_to_bytes(index)
        ends = np.concatenate([[0], np.cumsum(width)])[first]
        column = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.binary()), batch.column("row"), column.cast(pa.binary())], ["slice", "row", "numbers"])


def _segmented(model: str):
    """The ids of the chunks of each row; a chunk that the bucket has met is not segmented again."""

    def run(batches):
        sp = processor(model)
        known = {b"": np.array([sp.piece_to_id(MARK)], np.int32).tobytes()}
        for batch in batches:
            payload = []
            for blob in batch.column("held"):
                lengths, data = _unpacked(blob.as_py())
                ends = np.cumsum(lengths).tolist()
                found = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                if len(known) > REMEMBERED:
                    known = {b"": known[b""]}
                new = [c for c in dict.fromkeys(found) if c not in known]
                for chunk, ids in zip(new, sp.encode([c.decode() for c in new], num_threads=1), strict=True):
                    known[chunk] = np.array(ids, np.int32).tobytes()
                ids = [known[c] for c in found]
                values = np.frombuffer(b"".join(ids), np.int32)
                payload.append(_packed(numbers_to_bytes(values)[0], np.fromiter(map(len, ids), np.int64, len(ids)) // 4))
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("steps"), pa.array(payload, pa.binary())], ["slice", "steps", "ids"])

    return run


def _placed(batches):
    """Documents of each slice, which follow its dictionary in the sorted rows."""
    name, rest, table = None, [], None
    for batch in batches:
        names = batch.column("slice").to_pylist()
        edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for lo, hi in itertools.pairwise(edges):
            if lo == hi:
                continue
            if names[lo] != name:
                name, rest, table = names[lo], [], None
            part = batch.slice(lo, hi - lo)
            held = pc.is_valid(part.column("steps"))
            words = part.filter(held)
            # two slices of the same texts have one name: their rows are the same
            rest += zip(words.column("steps").to_pylist(), words.column("ids").to_pylist(), strict=True)
            docs = part.filter(pc.invert(held))
            if docs.num_rows:
                table = table or _dictionary_of(rest)
                yield from _with_ids(docs, *table)


def _dictionary_of(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, and where those of each chunk start and how many they are."""
    numbers, lengths, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for steps, blob in dict.fromkeys(rows):
        numbers.append(np.cumsum(bytes_to_numbers(np.frombuffer(steps, np.uint8)) + 1) - 1)
        sizes, data = _unpacked(blob)
        lengths.append(sizes)
        values.append(bytes_to_numbers(np.frombuffer(data, np.uint8)))
    number, size = np.concatenate(numbers), np.concatenate(lengths)
    starts, count = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    if not np.array_equal(np.sort(number), np.arange(len(number))):
        raise RuntimeError(UNSTABLE)
    starts[number], count[number] = np.cumsum(size) - size, size
    return np.concatenate(values), starts, count


def _with_ids(docs, values, starts, lengths):
    column = docs.column("numbers").cast(pa.large_binary())
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < docs.num_rows:
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_IDS // 2, "right"))
        to = min(max(to, at + 1), docs.num_rows)
        part = Texts.of_bytes(column.slice(at, to - at))
        chunk = bytes_to_numbers(part.data)
        if len(chunk) and int(chunk.max()) >= len(lengths):
            raise RuntimeError(UNSTABLE)
        ids = values[ragged(starts[chunk], lengths[chunk])]
        # chunks that end before each byte, then ids before each document
        before = np.concatenate([[0], np.cumsum(part.data < 128)])[part.offs]
        offs = np.concatenate([[0], np.cumsum(lengths[chunk])])[before]
        arrays = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([docs.column("row").slice(at, to - at), arrays], ["row", "ids"])
        at = to


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` without ``text`` and with its ids, no begin or end ids."""
    parts = shuffle_partitions(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "ids")]
    rows = docs.select(F.struct(F.lit(0).alias("__row"), *kept).alias("row"), F.col("text").cast("string").alias("text"))
    row = rows.schema["row"]
    numbered = rows.mapInArrow(_numbered, StructType([*StructType.fromDDL("slice binary"), row, *StructType.fromDDL("numbers binary")]))
    held = rows.select("text").mapInArrow(_dictionaries(parts), "slice binary, bucket int, steps binary, held binary")
    words = held.repartition(parts, "bucket").select("slice", "steps", "held").mapInArrow(_segmented(model), "slice binary, steps binary, ids binary")
    none = F.lit(None).cast("binary")
    both = words.select("*", F.lit(None).cast(row.dataType).alias("row"), none.alias("numbers")).unionByName(numbered.select("slice", none.alias("steps"), none.alias("ids"), "row", "numbers"))
    both = both.repartition(parts, "slice").sortWithinPartitions("slice", F.col("steps").isNull())
    found = both.mapInArrow(_placed, StructType([row, *StructType.fromDDL("ids array<int>")]))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("text", "ids")], "ids")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with the text of ``ids`` in ``decoded``, which replaces a column of this name; null ids are a null text."""
    rows = rows.drop("decoded")
    names = rows.columns

    def run(batches):
        sp = processor(model)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_IDS, "right"))
                to = min(max(to, at + 1), batch.num_rows)
                part = batch.slice(at, to - at)
                texts = [None if ids is None else sp.decode(ids) if ids else "" for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])
                at = to

    return rows.mapInArrow(run, widened(rows, "decoded string"))


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of each document."""
    found = decode(encode(docs.select("doc_id", "text"), model), model)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
