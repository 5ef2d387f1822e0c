"""Each operator against a brute-force version on a small table of awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import bpe, components, fingerprint, langid, licences, linededup, lm, mixing, ngram_join, packing, quality, tokencount
from graphloom.llm.text import Texts, hash_each, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({i: i + 32 for i in range(65, 91)})
BASE = " ".join(f"w{i}" for i in range(120))
FRENCH = "le chat noir et la souris grise dans la maison avec une porte ouverte " * 3
ENGLISH = "the black cat and the grey mouse in the house with an open door there " * 3
#: doc_id, text, lang, source, and columns whose names the operators use themselves
ROWS = [
    (1, BASE, "en", "b"),
    (2, BASE.replace("w60 ", "x "), "en", "b"),
    (3, BASE, "en", "a"),
    (4, None, "en", None),
    (5, "", None, "a"),
    (6, "one two", "en", None),
    (7, "One two", "en", "c"),
    (8, " \n\t ", "fr", "d"),
    (9, FRENCH + "\nune ligne répétée ici\nfin", "fr", "d"),
    (10, ENGLISH + "\n  Une ligne répétée ici \r\n\nthe end", "en", "a"),
    (11, "A line that is long enough\nA line that is long enough\nshort", "en", "a"),
    (12, "a LINE that is long enough\nother", "en", "a"),
    (13, "é" * 9 + "\n" + "ü" * 10, "de", "a"),
    (14, "é" * 9 + "\n" + "ü" * 10, "de", "a"),
    (15, " ".join(f"long{i % 997} word{i}" for i in range(4000)), "en", "b"),
    (16, "<|endoftext|> x  y  z 　 'tis don't I'll \U0001f600 12.5\n\n\nend", "en", "c"),
    (17, "Licensed under the Apache License, Version 2.0.\nReleased  under the mit license", "en", "c"),
    (18, "### $$$ *** " * 30, "en", "c"),
    (19, ENGLISH, "en", "c"),
    (19, ENGLISH, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, doc long, key string, n int, v string, size long, dropped string, fingerprint string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "k", 1, "v", 9, "d", "f", "x") for r in ROWS], SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOW) if lower else text or "")


def sets(rows):
    out = []
    for d, t, *_ in rows:
        w = words(t)
        out.append((d, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    return out


# 1


def targets(rows, budget=1.5, most=2.0):
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, open_, out = budget * sum(size.values()), set(order), {}
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * size[s]]
        if not over:
            break
        for s in over:
            out[s] = most * size[s]
            open_.discard(s)
    return size, out | {s: level * weight[s] for s in open_}


def test_mix_meets_targets(docs):
    size, want = targets(ROWS)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(ROWS)
    source = {d: s for d, _, _, s in ROWS}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    # the whole budget, and each source to a packet
    assert sum(taken.values()) == int(1.5 * sum(size.values()))
    assert all(abs(taken[s] - want[s]) <= 64 for s in want)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix_report(docs.repartition(2)).collect()}


@pytest.mark.parametrize("quantum", [1, 3, 64])
def test_mix_against_brute_force(docs, quantum):
    """Packets of all sources in one list, by finish time, until the budget is spent."""
    rows = [r for r in ROWS if r[0] != 19]
    size, target = targets(rows)
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    packets = []
    for number, s in enumerate(order):
        done = 0
        for turn in range(2):
            queue = sorted((hashlib.md5(f"17|{turn}|{d}".encode()).hexdigest()[:15], d, len(words(t))) for d, t, _, x in rows if x == s)
            for place, d, n in queue:
                for at in range(0, n, quantum):
                    w = min(quantum, n - at)
                    done += w
                    packets.append((done / target[s], number, turn, place, d, at, w))
    left, want = int(1.5 * sum(size.values())), Counter()
    for *_, d, _, w in sorted(packets):
        want[d] += min(w, left)
        left -= min(w, left)
    got = {r.doc_id: r.taken for r in mixing.mix_report(docs.where("doc_id <> 19"), quantum=quantum).collect()}
    assert got == {d: want[d] for d, *_ in rows}


def test_mix_over_ranges_and_buckets(docs, monkeypatch):
    """Many ranges and buckets give what one gives."""
    once = {(r.doc_id, r.taken) for r in mixing.mix_report(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert {(r.doc_id, r.taken) for r in mixing.mix_report(docs).collect()} == once


def test_mix_rows(docs):
    report = {(r.doc_id): r.taken for r in mixing.mix_report(docs.where("doc_id <> 19")).collect()}
    mixed = mixing.mix(docs.where("doc_id <> 19"))
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        original = next(t for d, t, *_ in ROWS if d == r.doc_id)
        assert original.startswith(r.text)
    assert {d: n for d, n in report.items() if n} == dict(got)


def test_mix_cuts_inside_equal_rows(spark):
    rows = [(1, "a b c d e f g", "x")] * 5 + [(2, "h i j", "y")] * 3 + [(None, "k l", None)] * 3 + [(4, None, "x")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, n int")
    for budget in (0.3, 0.7, 1.1, 1.5):
        want, got = Counter(), Counter()
        for r in mixing.mix_report(docs, budget=budget).collect():
            want[r.doc_id] += r.taken
        for r in mixing.mix(docs, budget=budget).collect():
            got[r.doc_id] += len(words(r.text))
        assert +want == got


def test_mix_of_nothing(nothing):
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix(nothing).count() == 0


# 2 and 9

TOKENIZER = "byte_bpe_50k.json"


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.resolve(TOKENIZER)).encode(text or "", add_special_tokens=False)


def test_encoder_equals_the_tokenizer():

    texts = [r[1] for r in ROWS] + ["x \n y", "a  b", "tab\t c", "  em space", "'s 't it's", "naïve façade über", "日本語 の 文", "end \n"]
    encoder = bpe.Encoder(TOKENIZER)
    for _ in range(2):  # the second time from memory
        ids, first = encoder.encode(Texts.of(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == ids_of(t).ids, t


@pytest.mark.parametrize("block", [64, 2_000_000])
def test_packing_is_a_round_trip(docs, block):
    got = packing.pack(docs, block_tokens=block).collect()
    want = {d: [*ids_of(t).ids, 0] for d, t, *_ in ROWS}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, ids in want.items():
        starts = sorted((r.start, r.length, r.ids_crc32) for r in pieces[d])
        if d == 19:
            starts = starts[::2]
        at = 0
        for start, length, crc in starts:
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_packing_pads_less_than_a_sequence():
    lengths = np.array([700, 650, 600, 400, 300, 90, 1, 2500, 1024])
    found = packing.assign(lengths, 1024, 1.0, 1 / 1024)
    fill = Counter()
    for _, _, n, b, _ in found:
        fill[b] += n
    assert sum(1024 - n for n in fill.values()) < 1024
    assert sum(fill.values()) == lengths.sum()


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0


def test_tokens_are_attributed_once(docs):
    got = defaultdict(list)
    for r in tokencount.count_sections(docs).collect():
        got[r.doc_id].append(r)
    for d, t, *_ in ROWS:
        if d == 19:
            continue
        rows = sorted(got[d], key=lambda r: r.section)
        parts = re.findall(r"[^\n]*\n|[^\n]+", t or "") or [""]
        assert [r.length for r in rows] == [len(p) for p in parts]
        bounds, at = [], 0
        for p in parts:
            bounds.append(at)
            at += len(p)
        bounds.append(at)
        want = [0] * len(parts)
        code = ids_of(t)
        for a, b in code.offsets:
            over = [max(0, min(b, bounds[i + 1]) - max(a, bounds[i])) for i in range(len(parts))]
            want[over.index(max(over))] += 1
        assert [r.n_tokens for r in rows] == want and rows[0].doc_tokens == len(code.ids)


def test_crossing_tokens_go_where_most_of_them_is():
    section, crossing = tokencount.allocate(np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12]), np.array([0, 4, 7, 11]))
    assert section.tolist() == [0, 1, 2, 2] and crossing.tolist() == [1, 2, 3]


# 3


def brute_components(rows):
    named = sets(rows)
    parent = {d: d for d, _ in named}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(named):
        for b, u in named[i + 1 :]:
            both = len(s & u)
            if both and 100 * both >= 80 * (len(s) + len(u) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(d, len(s), find(d)) for d, s in named}


def test_ngram_join(docs):
    got = ngram_join.join_documents(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(ROWS)


def test_ngram_join_of_near_copies(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        base = [f"t{j}" for j in range(60)] if i % 3 else [f"t{j}" for j in range(20)] + [f"u{i}_{j}" for j in range(30)]
        for _ in range(rng.integers(0, 3)):
            base[rng.integers(0, len(base))] = f"e{rng.integers(0, 9)}"
        rows.append((i, " ".join(base), None, None))
    frame = spark.createDataFrame([(d, t) for d, t, *_ in rows], "doc_id long, text string").repartition(4)
    # whole groups, and groups dealt to blocks that meet each other
    for block in (1_000_000, 2_000):
        got = ngram_join.join_documents(frame, block=block).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_long_lists_are_merged_like_short_ones():
    rng = np.random.default_rng(3)
    runs = [np.unique(rng.integers(0, 900, n)) for n in (300, 5, 80, 1)]
    want = Counter(x for r in runs for x in r.tolist())
    for some in (runs, runs[1:]):
        want = Counter(x for r in some for x in r.tolist())
        found, count = ngram_join.merged(some)
        assert dict(zip(found.tolist(), count.tolist(), strict=True)) == want


def test_rows_of_one_document_are_connected(spark):
    rows = [(1, BASE), (2, ENGLISH), (2, BASE), (3, FRENCH), (4, ENGLISH)]
    got = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 1)]


def test_divide_skip_counts_exactly():
    rng = np.random.default_rng(2)
    for _ in range(50):
        query = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        candidates = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in rng.integers(1, 50, 8)]
        candidates += [np.setdiff1d(query, query[rng.random(len(query)) < rng.choice([0.05, 0.2])]) for _ in range(8)]
        got = ngram_join.divide_skip(query, candidates)
        both = [len(np.intersect1d(query, c)) for c in candidates]
        assert got.tolist() == [100 * o >= 80 * (len(query) + len(c) - o) for c, o in zip(candidates, both, strict=True)]
        assert got.any()


def test_ngram_join_of_nothing(nothing):
    assert ngram_join.join_documents(nothing).count() == 0


def test_null_ids_stay_null(spark):
    got = ngram_join.join_documents(spark.createDataFrame([(None, BASE), (3, BASE), (4, "x")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "None"), ("4", "4"), ("None", "None")]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.v: r.component for r in components.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_short_texts_are_one_shingle():

    h, first = Texts.of(pa.array(["a b", "b a", "", None, "a b c d e", "a b"])).word_hashes()
    got = [s.tolist() for s in shingles(h, first)]
    assert [len(s) for s in got] == [1, 1, 0, 0, 1, 1] and got[0] == got[5] != got[1]


# 4


def test_language_model(docs):
    got = lm.score_documents(docs).collect()
    assert len(got) == len(ROWS)
    tokens = [(d, [*words(t), None]) for d, t, *_ in ROWS]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = {d: (held(d), len(ws), sum(count[w] > 0 for w in ws), n, sum(np.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws)) for d, ws in tokens}
    for r in got:
        h, m, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, m, known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    again = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_language_model_probabilities_sum_to_one(spark):
    """One-word texts in one context: their words and the unseen word are all there is."""
    rows = [(i, f"w{i % 9}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    unseen = spark.createDataFrame([(next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2), "never")], "doc_id long, text string")
    got = lm.score_documents(frame.unionByName(unseen)).collect()
    word = {}
    for r in got:
        word["never" if r.doc_id >= 1000 else f"w{r.doc_id % 9}"] = r.score
    # the end token follows each word with its own probability: fold it out by a bound
    assert sum(10**s for s in word.values()) <= 1.0 + 1e-9


def test_stirling_numbers_and_seating():
    table = lm.stirling(0.5, 6)
    # S_d(c, 1) is the rising product (1 - d)(2 - d)...(c - 1 - d), S_d(c, c) is 1
    assert np.exp(table[4, 1]) == pytest.approx(0.5 * 1.5 * 2.5) and np.exp(table[6, 6]) == pytest.approx(1)
    draws = np.arange(4, dtype=np.uint64)
    c = np.array([1, 2, 50, 5000])
    few = lm.draw_tables(c, np.full(4, 1e-6), 0.5, lm.stirling(0.5, lm.EXACT), draws)
    many = lm.draw_tables(c, np.full(4, 1e6), 0.5, lm.stirling(0.5, lm.EXACT), draws)
    assert few.tolist() == [1, 1, 1, 1] and (many <= c).all() and many[3] > 4000


def brute_scores(rows, chains=2, sweeps=2, theta=1.0, seed=11):
    """The same draws over dicts of all words and contexts, without slices."""
    hashed = lambda w: lm.END if w is None else hash_each(pa.array([w.encode()]))[0]
    texts = {d: [*words(t), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    pairs = {d: [(w, ws[i - 1] if i else "") for i, w in enumerate(ws)] for d, ws in texts.items()}
    c = Counter(x for d, xs in pairs.items() if not held[d] for x in xs)
    customers = Counter()
    for (_, u), m in c.items():
        customers[u] += m
    n = Counter()
    for (w, _), m in c.items():
        n[w] += m
    width = Counter(w for w, _ in c)
    d = lm.discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    d0 = lm.discount(sum(x == 1 for x in width.values()), sum(x == 2 for x in width.values()))
    table, table0 = lm.stirling(d, lm.EXACT), lm.stirling(d0, lm.EXACT)
    context = lambda u: 0 if u == "" else max(int(lm.mix(np.array([hashed(u)]))[0]) >> 32, 1)
    uniform, mean = 1 / (len(n) + 1), Counter()
    for k in range(chains):
        t, root, t0 = dict.fromkeys(c, 1), dict(width), dict.fromkeys(n, 1)

        def totals():
            per = Counter()
            for (_, u), m in t.items():
                per[u] += m
            return per, sum(root.values()), sum(t0.values())

        def base(w):
            return (root.get(w, 0) - d0 * t0.get(w, 0) + (theta + d0 * all0) * uniform) / (theta + all_tables)

        for sweep in range(1, sweeps + 1):
            per, all_tables, all0 = totals()
            salt = np.uint64([(seed * 1000 + sweep) * 1000 + k])
            new = {}
            for (w, u), m in c.items():
                h = lm.fold(lm.fold(np.array([hashed(w)]), np.array([context(u)], np.uint64)), salt)
                new[w, u] = int(lm.draw_tables(np.array([m]), np.array([(theta + d * per[u]) * base(w)]), d, table, h)[0])
            t = new
            root = Counter()
            for (w, _), m in t.items():
                root[w] += m
            rest = np.array([(theta + d0 * all0) * uniform])
            t0 = {w: int(lm.draw_tables(np.array([m]), rest, d0, table0, lm.fold(np.array([hashed(w)]), salt))[0]) for w, m in root.items()}
        per, all_tables, all0 = totals()
        for x in {x for xs in pairs.values() for x in xs}:
            w, u = x
            mean[x] += ((theta + d * per[u]) * base(w) + c.get(x, 0) - d * t.get(x, 0)) / (theta + customers[u]) / chains
    return {d: sum(np.log10(mean[x]) for x in xs) for d, xs in pairs.items()}


def test_language_model_scores_against_brute_force(docs, spark):
    want = brute_scores([(d, t) for d, t, *_ in ROWS])
    for slices in (1, 3, 16):
        got = {r.doc_id: r.score for r in lm.score_documents(docs, slices=slices).collect()}
        assert got == pytest.approx(want, rel=1e-6)


def test_language_model_without_training(nothing, spark):
    assert lm.score_documents(nothing).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)


# 5


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_line_dedup(docs, batches):
    holders = defaultdict(set)
    for d, t, *_ in ROWS:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders[key_of(line)].add(d)
    want = Counter()
    for d, t, *_ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key_of(x)) >= 10 and len(holders[key_of(x)]) > 1 and min(holders[key_of(x)]) != d)]
        want[d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = linededup.dedup_lines(docs, batches=batches, fan_in=2)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()) == want
    assert set(docs.columns) <= set(got.columns)


def test_line_dedup_of_nothing(nothing):
    assert linededup.dedup_lines(nothing).count() == 0


# 6


def test_fingerprints(docs):
    got = {}
    for r in fingerprint.edited_report(docs).collect():
        got.setdefault(r.doc_id, r)
    order = sorted(ROWS, key=lambda r: -r[0])
    for i, (d, t, *_) in enumerate(order):
        if i and order[i - 1][0] == d:
            continue
        text, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1
    assert got[1].fingerprint == got[3].fingerprint != got[9].fingerprint
    assert got[4].fingerprint == got[5].fingerprint


def test_fingerprints_follow_edits():
    walk = fingerprint.Walk()
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefghij klmnop"), 3000))
    other = "".join(rng.choice(list("abcdefghij klmnop"), 3000))
    few = text[:1000] + "xyz" + text[1000:2000] + text[2003:]
    a, b, c = walk.fingerprints([text, few, other])
    near, far = fingerprint.likeness_of([a, a], [b, c])
    assert near > 0.8 > 0.3 > far
    assert walk.fingerprints([few]) == [b]


def test_near_pairs(spark):
    walk = fingerprint.Walk()
    text = " ".join(f"word{i}" for i in range(300))
    changed = text.replace("word40 ", "").replace("word150", "something") + " end"
    prints = walk.fingerprints([text, text, changed, " ".join(f"other{i * 7}" for i in range(300))])
    assert prints[0] == prints[1] != prints[2]
    frame = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    assert [(r.a, r.b) for r in fingerprint.near_pairs(frame).collect()] == [(0, 2)]


def test_near_pairs_inside_a_bucket(spark):
    # all buckets that B and C share are in the order A, B, X, C; only B and C are near
    rng = np.random.default_rng(3)
    common, *own = ("".join(rng.choice(list("0123456789abcdef"), 36 if not i else 88)) for i in range(4))
    a, b, x = (f"{place}0ff{tail}{common}" for place, tail in zip("124", own, strict=True))
    c = "".join(format(15 - int(ch, 16), "x") if i % 4 == 0 and i < 92 else ch for i, ch in enumerate(b))
    assert a < b < x < c
    frame = spark.createDataFrame(list(enumerate([a, b, x, c])), "doc_id long, fingerprint string")
    assert [(r.a, r.b) for r in fingerprint.near_pairs(frame).collect()] == [(1, 3)]


@pytest.mark.parametrize("least,bands", [(0.8, 32), (0.6, 16)])
def test_near_pairs_against_brute_force(spark, least, bands):
    rng = np.random.default_rng(4)
    hexes, prints = np.array(list("0123456789abcdef")), []
    for _ in range(4):
        base = rng.integers(0, 16, 128)
        for _ in range(20):
            made = np.where(rng.random(128) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 16, 128), base)
            made[:8] = 0
            prints.append("".join(hexes[made]))
    want = {}
    for i in range(80):
        near = fingerprint.likeness_of([prints[i]] * 80, prints)
        want |= {(i, j): near[j] for j in range(i + 1, 80) if near[j] >= least}
    frame = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    got = [((r.a, r.b), r.near) for r in fingerprint.near_pairs(frame, least, bands, block=7, every=True).collect()]
    assert len(got) == len(want) and dict(got) == want

    def labels(pairs):
        label = list(range(80))
        for i, j in pairs:
            x, y = label[i], label[j]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    few = [(r.a, r.b) for r in fingerprint.near_pairs(frame, least, bands, block=7).collect()]
    assert set(few) <= set(want) and labels(few) == labels(want)


def test_fingerprints_of_nothing(nothing, spark):
    assert fingerprint.edited_report(nothing).count() == 0
    one = fingerprint.edited_report(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


# 7


def test_language_identification(spark, docs):
    train = spark.createDataFrame([(ENGLISH, "en"), (FRENCH, "fr"), (None, "en"), ("x", None)], "text string, lang string")
    model = langid.fit(train)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[10].lang_pred == got[19].lang_pred == "en" and got[9].lang_pred == "fr"
    for d in (4, 5, 8):
        assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def vector(point, dim=1024, seed=5):
    return 1.0 - 2.0 * langid.letter_bits(np.array([point]), dim, seed)[0]


def brute_grams(text):
    """Trigrams of code points, runs of other characters as one 0."""
    points = []
    for ch in (text or "").lower():
        if ch.isalpha() or not points or points[-1]:
            points.append(ord(ch) if ch.isalpha() else 0)
    return Counter(zip(points, points[1:], points[2:], strict=False))


def brute_bundle(counts):
    return sum((n * np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for (a, b, c), n in counts.items()), np.zeros(1024))


GREEK = "η γάτα και το ποντίκι στο σπίτι με μια ανοιχτή πόρτα " * 3
RUSSIAN = "чёрная кошка и серая мышь в доме с открытой дверью там " * 3
UKRAINIAN = "чорна кішка і сіра миша в будинку з відчиненими дверима там " * 3


def test_languages_against_whole_vectors(spark):
    """Prototypes, answers and cosines of five languages in three scripts are those of vectors of whole texts."""
    known = {"el": GREEK, "en": ENGLISH, "fr": FRENCH, "ru": RUSSIAN, "uk": UKRAINIAN}
    train = spark.createDataFrame([(t, x) for x, t in known.items()] * 2, "text string, lang string").repartition(3)
    model = langid.fit(train)
    whole = {x: 2 * brute_bundle(brute_grams(t)) for x, t in known.items()}
    assert set(model) == set(whole) and all(np.allclose(model[x], whole[x]) for x in whole)
    texts = {i: t[i * 7 : i * 7 + 60] for i, t in enumerate(known.values())} | {5: "12 İx Straße\n\nß 漢字かな", 6: "ab", 7: "a b"}
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), model).collect()}
    for i, text in texts.items():
        counts = brute_grams(text)
        norm = np.sqrt(1024 * max(sum(n * n for n in counts.values()), 1))
        cosine = {x: brute_bundle(counts) @ v / np.linalg.norm(v) / norm for x, v in whole.items()}
        assert got[i].score == pytest.approx(min(max(*cosine.values(), 0), 1), abs=1e-5)
        if i < 5:
            assert got[i].lang_pred == max(cosine, key=cosine.get) == list(known)[i]
            assert np.linalg.norm(brute_bundle(counts)) == pytest.approx(norm, rel=0.2)


# 8


def test_quality_signals():

    for _, t, *_ in ROWS + [(0, "a b c a b c\n\nx\nx\n \n x\nx", None, None)]:
        found = quality.signals(Texts.of(pa.array([t, "q w e"])))
        w, lines = words(t, lower=False), (t or "").split("\n")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked))
        assert tuple(int(found[s][0]) for s in quality.SIGNALS) == want, t
        assert int(found["n_words"][1]) == 3


def test_quality_model(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(ENGLISH.split(), 60)) for _ in range(60)]
    bad = [" ".join(w + "$$$" for w in rng.choice(ENGLISH.split(), 60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    odd = [i for i in range(1, 120, 2) if not got[i].base_failed]
    assert np.mean([got[i].kept == (i < 60) for i in odd]) > 0.95
    assert all(0 <= r.quality_prob <= 1 for r in got.values())


def test_quality_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.judge(docs, model).collect()
    assert all(r.kept != r.base_failed for r in got) and len(got) == len(ROWS)
    assert quality.judge(nothing, model).count() == 0


# 10


def test_licences(docs, nothing):
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert got[17].licences == "apache-2.0,mit" and got[17].best_dice == 1.0
    assert all(not r.licences for d, r in got.items() if d != 17)
    assert licences.scan_licences(nothing).count() == 0


def test_dice_against_brute_force():
    scanner = licences.Scanner(licences.TEMPLATES, 0.8)
    text = "Intro.\n\nThis work is licensed under the  GNU general public license (version 3). Thanks!\nReleased under MIT License"
    found, _ = scanner.scan(text)
    want = {}
    for part in ("Intro.", "This work is licensed under the  GNU general public license (version 3).", "Thanks!", "Released under MIT License"):
        w = re.findall(r"[^\W_]+", part.lower())
        for name, template in licences.TEMPLATES.items():
            x, y = set(zip(w, w[1:], strict=False)), set(zip(*(lambda v: (v, v[1:]))(re.findall(r"[^\W_]+", template.lower())), strict=False))
            if x and (d := 2 * len(x & y) / (len(x) + len(y))) >= 0.8:
                want[name] = max(d, want.get(name, 0))
    assert found == want == {"gpl-3.0": 1.0}


def test_licences_over_lines_and_inside_sentences():
    scanner = licences.Scanner(licences.TEMPLATES, 0.8)
    inside = "Unless stated, code is released under the MIT License."
    assert scanner.scan(inside)[0] == {"mit": 1.0}
    wrapped = "Some words first. Licensed under the\n  Apache License, Version 2.0. And more of other words\nthat go on and on."
    assert scanner.scan(wrapped)[0] == {"apache-2.0": 1.0}
    header = "\n * ".join(licences.TEMPLATES["apache-2.0-header"].split("License. "))
    assert scanner.scan(f"Copyright 2020 nobody\n\n * {header}\nimport os")[0]["apache-2.0"] == 1.0
    assert scanner.scan(f"Copyright 2020 nobody\n\n{licences.TEMPLATES['apache-2.0-header']}\nimport os")[0]["apache-2.0-header"] == 1.0
    assert scanner.scan(f"MIT License\n\nCopyright x\n\n{licences.TEMPLATES['mit-text']}\n\nend")[0]["mit-text"] == 1.0
    assert scanner.scan("mit license the mit " * 5000)[0] == {}


def test_licences_are_the_best_of_all_windows():
    rng = np.random.default_rng(5)
    for _ in range(60):
        template = list(rng.choice(list("abcdef"), rng.integers(3, 9)))
        text = list(rng.choice(list("abcdefgh"), 40))
        b, want = licences.bigrams(template), 0.0
        for lo in range(40):
            for hi in range(lo + 2, 41):
                a = licences.bigrams(text[lo:hi])
                want = max(want, 2 * len(a & b) / (len(a) + len(b)))
        found, _ = licences.Scanner({"t": " ".join(template)}, 0.7).scan(" ".join(text))
        assert found == ({"t": want} if want >= 0.7 else {})


@pytest.mark.parametrize("within", [True, False])
def test_block_search_connects_what_links(within):

    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    for _ in range(20):
        sets = []
        for _ in range(40):
            keep = base[rng.random(100) > rng.choice([0.02, 0.12, 0.9])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 50, rng.integers(1, 12)).astype(np.uint64)])))
        n = np.array([len(s) for s in sets])
        side = np.zeros(40, int) if within else (np.arange(40) >= 20).astype(int)
        table = pa.table({"side": side, "key": np.arange(40), "n": n, "c": np.arange(40), "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})
        got = ngram_join._search_blocks(table)
        want = [(i, j) for i in range(40) for j in range(i + 1, 40) if (within or side[i] != side[j]) and 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (n[i] + n[j])]

        def groups(pairs):
            label = list(range(40))
            for a, b in pairs:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
            return label

        found = list(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True))
        assert {tuple(sorted(p)) for p in found} <= set(want)
        assert groups(found) == groups(want)
