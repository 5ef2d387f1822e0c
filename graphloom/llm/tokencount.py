"""Operator 9: token counts by sections, attributed through character offsets.

A document is encoded once, as a whole; its tokens' character spans are then
interval-joined to its sections (lines with their newline) by one sorted search.
A token that crosses a boundary is counted once, in the section that holds most of
its characters, the earliest of equals.  So the sections' counts sum to the
document's count, which encoding sections apart would not give.

Null and empty texts are one empty section without tokens; repeated rows give their
sections each; very long texts are encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import Encoder
from graphloom.llm.text import Texts, sliced

SCHEMA = "doc_id long, section long, start long, length long, n_tokens long, n_crossing long, doc_tokens long"


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and the tokens that cross a boundary.

    ``bounds`` are the ascending starts of sections; empty tokens fall to the
    section of their start.
    """
    low = np.searchsorted(bounds, starts, "right") - 1
    high = np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1
    crossing = np.flatnonzero(high > low)
    for i in crossing.tolist():
        edges = np.concatenate([[starts[i]], bounds[low[i] + 1 : high[i] + 1], [ends[i]]])
        low[i] += int(np.argmax(np.diff(edges)))
    return low, crossing


def count_sections(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per section of each row of ``docs(doc_id, text)``."""

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in sliced(batches):
            texts = Texts.of(batch.column("text"))
            n = len(texts)
            ids, first = encoder.encode(texts)
            starts, ends = encoder.spans(texts, ids)
            # a section starts with each text and after each newline inside it
            data, offs = texts.data, texts.offs
            newline = np.flatnonzero(data == 0x0A) + 1
            inner = newline[~np.isin(newline, offs)]
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
            full = np.flatnonzero(offs[1:] > offs[:-1])
            at = np.sort(np.concatenate([offs[:-1][full], inner]))
            bounds = lead[at]
            section, crossing = allocate(starts, ends, bounds)
            tokens = np.bincount(section, minlength=len(at))
            over = np.bincount(section[crossing], minlength=len(at))
            doc = np.searchsorted(offs, at, "right") - 1
            lengths = np.diff(np.append(bounds, lead[-1]))
            # texts without characters have one empty section
            empty = np.flatnonzero(offs[1:] == offs[:-1])
            zero = np.zeros(len(empty), np.int64)
            doc = np.concatenate([doc, empty])
            order = np.argsort(doc, kind="stable")
            doc = doc[order]
            join = lambda x: np.concatenate([x, zero])[order]  # noqa: E731, B023
            begin = join(bounds - lead[offs[np.searchsorted(offs, at, "right") - 1]])
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    *(pa.array(x.astype(np.int64)) for x in (number, begin, join(lengths), join(tokens), join(over), np.diff(first)[doc])),
                ],
                ["doc_id", "section", "start", "length", "n_tokens", "n_crossing", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
