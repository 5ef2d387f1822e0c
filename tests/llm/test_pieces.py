"""SentencePiece ids and texts against the library on whole texts."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pieces
from graphloom.llm.text import Texts

TEXTS = [
    None,
    "",
    " ",
    "  ",
    "a",
    "a ",
    " a",
    "  a  b  ",
    "a▁b▁▁c▁",
    "▁",
    "line\nnext\tand\r\n  indented",
    "<s> </s> <unk> <0x41> <pad>",
    "a\x00b c",
    "Ａｂｃ　é é ﬁ",
    "你好，世界。今天天气很好" * 40,
    "😀 👩‍👩‍👧 mixed 😀words",
    " " * 70 + "x" + " " * 33,
    "w" * 5000 + " " + "the " * 3000,
    "the cat the cat 123 4567",
    "the cat the cat 123 4567",
]
SCHEMA = "doc_id long, text string, slice string, row string, number int, ids string, decoded string"


@pytest.fixture(scope="module")
def library():
    return pieces.processor(pieces.MODEL)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pieces") / "docs")
    spark.createDataFrame([(i, t, "s", "r", i, "x", "y") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_equals_library(docs, library):
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(docs)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "")
        assert got[i].ids == ids
        assert got[i].decoded == (library.decode(ids) if ids else "")
        assert (got[i]["slice"], got[i]["row"], got[i].number) == ("s", "r", i)


def test_digests(docs, library):
    for r in pieces.report(docs).collect():
        ids = library.encode(TEXTS[r.doc_id] or "")
        text = library.decode(ids) if ids else ""
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_many_slices(docs, library, monkeypatch):
    """Slices of one row each, and output batches of a few ids."""
    monkeypatch.setattr(pieces, "SLICE", 1)
    monkeypatch.setattr(pieces, "BATCH_IDS", 4)
    got = {r.doc_id: r.ids for r in pieces.encode(docs).collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(TEXTS)}


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pieces.report(empty).collect() == []
    assert pieces.encode(empty).columns == ["doc_id", "slice", "row", "number", "decoded", "ids"]
    rows = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [(r.k, r.decoded) for r in pieces.decode(rows).orderBy("k").collect()] == [(1, None), (2, "")]
    assert [r.ids for r in pieces.encode(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()] == [[264, 287]] * 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**33), max_size=50))
def test_numbers(values):
    data, width = pieces.numbers_to_bytes(np.array(values, np.int64))
    assert int(width.sum()) == len(data)
    assert pieces.bytes_to_numbers(data).tolist() == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ▁\n", max_size=12), min_size=1, max_size=6))
def test_chunks_rebuild(texts):
    import pyarrow as pa

    spaced = [t.replace("▁", " ") for t in texts]
    index, uniq, first = pieces.chunks(Texts.of(pa.array(spaced)))
    words = [w.decode() for w in uniq.to_pylist()]
    assert [" ".join(words[i] for i in index[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)] == spaced
