"""The prefix trie against a brute-force version over plain dictionaries."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from graphloom.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def turns_of(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            out[c].append(((turn is not None, turn or 0, digest), role, text))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        childless = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in below)]
        ends = sorted(c for c in members if len(convs[c]) == len(key))
        saved = sum((len(nodes[k]) - 1) * len(WORD.findall(k[-1][1])) for k in below if k)
        out.append(
            (
                min(members),
                len(key),
                min(nodes[key[:-1]]) if key else None,
                len(members),
                len(ends),
                sum(len(k) == len(key) + 1 for k in below),
                len(childless),
                saved,
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
ROWS = (
    [(c, t, "user" if t % 2 == 0 else None, f"text {t % 3}" if t < 3 else f"own {c} {t}") for c in range(60, 90) for t in range(c % 7)]
    # copies, a growing conversation logged each time it grew, and a long one
    + [(200 + i, t, "u", f"copy {t}") for i in range(40) for t in range(4)]
    + [(400 + i, t, "u", f"grow {t}") for i in range(25) for t in range(i + 1)]
    + [(300, t, "u", "x " * (t % 5)) for t in range(150)]
    # nulls, ties, repeated rows, clashes of role and text, a negative id
    + [(500, None, "u", "first"), (500, 1, None, None), (500, 1, "u", "tie"), (500, 1, "u", "tie"), (None, 1, "u", "lost"), (501, 1, "ab", "c"), (502, 1, "a", "bc"), (-7, 1, "u", "minus"), (-20, 5, "u", "base"), (503, 2, "", "long " * 20000)]
)
SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth int, j int, digest string, words string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "d", "w") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("make, plain", [(trie.rebuilt, rebuilt), (trie.as_they_are, lambda c: c)])
def test_against_brute_force(spark, make, plain, monkeypatch):
    monkeypatch.setattr(trie, "STEP", 16)
    monkeypatch.setattr(trie, "RUN", 3)
    got = trie.prefix_trie(table(spark, ROWS), make).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == brute(plain(turns_of(ROWS)))


def test_empty_and_turnless(spark):
    assert trie.prefix_trie(table(spark, []), trie.rebuilt).collect() == []
    # conversations whose own turns all fall to the base, which is absent
    few = [(c, 0, "u", "only") for c in range(1, 9)]
    got = trie.prefix_trie(table(spark, few), trie.rebuilt).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rebuilt(turns_of(few)))
