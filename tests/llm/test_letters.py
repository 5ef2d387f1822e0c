"""Characters that must not be merged, and scores that must not depend on neighbours."""

import pyarrow as pa
import pytest

from graphloom.llm import fingerprint, langid
from graphloom.llm.text import Texts, mix

import numpy as np


def alike(a, b):
    walk = fingerprint.Walk()
    return float(fingerprint.likeness_of(walk.fingerprints([a]), walk.fingerprints([b]))[0])


@pytest.mark.parametrize("first, last", [(0x4E00, 0x9FFF), (0x0400, 0x04FF)])
def test_characters_of_one_row_differ(first, last):
    """Every character of a text replaced by another that walks by the same row."""
    row = lambda c: int(mix(np.array([c], np.uint64))[0] & np.uint64(127))
    by = {}
    for c in range(first, last + 1):
        by.setdefault(row(c), []).append(chr(c))
    pairs = [(v[0], v[1]) for v in by.values() if len(v) > 1]
    text, other = "".join(a for a, _ in pairs) * 20, "".join(b for _, b in pairs) * 20
    assert alike(text, text) == 1.0
    assert alike(text, other) < 0.2


def test_planted_edits_of_other_scripts():
    text = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(2000))
    few = text[:500] + text[501:1500] + "里" + text[1500:]
    assert alike(text, few) > 0.7
    assert alike(text, "".join(chr(ord(c) + 1) for c in text)) < 0.2
    assert alike("a\x00b" * 50, "a\x01b" * 50) < 0.9
    assert alike("", "\x00" * 10) < 0.3


def test_final_letters_do_not_depend_on_the_next_text():
    table = langid.letters()

    def grams(texts):
        distinct, of, gram, times, _ = langid.grams(Texts.of(pa.array(texts)), table)
        return {(tuple(distinct[g].tolist()), int(n)) for t, g, n in zip(of, gram, times, strict=True) if t == 0}

    assert grams(["ΟΔΟΣ"]) == grams(["ΟΔΟΣ", "alpha"]) == grams(["ΟΔΟΣ", ""]) == {((0x3BF, 0x3B4, 0x3BF), 1), ((0x3B4, 0x3BF, 0x3C2), 1)}
    assert grams(["İstanbul"]) == grams(["İstanbul", "x"])
