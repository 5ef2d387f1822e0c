"""Texts of two megabytes, ties and repeated rows."""

import hashlib

import numpy as np
import pytest

from graphloom.llm import langid, licences, linededup, packing, quality

PARTS = [f"the quick brown fox number {i % 4999} jumps over the lazy dog {i}" for i in range(32000)]
LONG = "\n".join(PARTS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en"), (2, PARTS[7] + "\nown line of this text", "en"), (2, PARTS[7] + "\nown line of this text", "en"), (3, "le chat et la souris " * 9, "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_lines_of_long_texts(docs):
    assert len(LONG) > 2_000_000 / 1.1
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert (got[1].n_lines, got[1].n_dropped) == (32000, 0) and got[1].kept_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert got[2].n_dropped == 1 and got[2].text == "own line of this text"


def test_language_of_long_and_repeated_texts(docs):
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in found) == [(1, "en"), (2, "en"), (2, "en"), (3, "fr")]
    assert len({r.score for r in found if r.doc_id == 2}) == 1


def test_signals_of_long_texts(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs.select("doc_id", "text"), quality.fit(docs, labels)).collect()}
    assert got[1].n_words == sum(len(p.split()) for p in PARTS)
    assert got[1].word_chars == sum(len(w) for p in PARTS for w in p.split())


def test_licence_deep_in_a_long_text(spark):
    text = LONG[:1_000_000] + "\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\n" + LONG[1_000_000:]
    found = licences.scan_licences(spark.createDataFrame([(1, text), (2, LONG[:5000])], "doc_id long, text string"))
    best = {r.doc_id: r.best_licence for r in found.select("doc_id", "best_licence").collect()}
    assert best[1] is not None and "pache" in best[1] and best[2] is None


def test_ties_of_packing():
    pieces = packing.assign(np.array([3, 3, 3, 3]), 6, 1.0, 0.0)
    assert [(d, s) for d, _, _, s, _ in pieces] == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert packing.assign(np.array([3, 3, 3, 3]), 6, 1.0, 0.0) == pieces
