"""Operator 3: exact n-gram Jaccard join by T-occurrence search.

Documents are sets of distinct five-word shingles (64-bit hashes).  Equal sets form
a class (key: 64-bit set hash); everything below works on classes, so exact copies are
never expanded into pairs.

Two sets of sizes a and b link if they share ``T = ceil(4 (a + b) / 9)`` shingles
(Jaccard 0.8).  Given one global order of shingles, a set of n posts its first
``n - ceil(0.8 n) + l`` ones, ``l = 1 + n // 16``; linked sets share at least
``min(l, l')`` posted shingles, whatever the order is.  It is used twice:

1. *Who may link.*  Shingles in the order of their hashes, the most frequent ones (a
   bounded table) last.  Lists of one class are dropped, and classes that share too
   few posted shingles with anybody leave.  The sets of the others are made again.
2. *Rarest first.*  Shingles ordered by the number of these sets that hold them.
   Passages that unrelated documents share are posted by hardly anybody now; who
   still shares enough is grouped with those of its lists.

Each group is searched in one task of bounded memory: every set is a query of a
T-occurrence search by DivideSkip.  Its inverted lists are split, the short ones are
merged, and the candidates that can still reach T are probed in the long ones by
binary search.  What a query's component holds already is skipped, so a group of near
copies costs about one query for each member that links with none, and gives one link
for each that does.

A group of over ``block`` shingles is dealt to blocks by hash.  Two rounds search the
blocks by themselves, dealt anew each; then lists within one component tell nothing
new, who shares too few others leaves, and of what is left every two blocks are
searched with each other.  No pair is dropped: a skipped one is connected already, or
shares too little.

Null and empty texts have an empty set and link with nothing; rows with equal
doc_id are one document, whose classes are connected; texts of under five words are
one shingle; texts of any length are taken whole, a set being held by one task; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.text import Texts, shingles, sliced
from graphloom.session import cut, shuffle_partitions

#: Most frequent shingles that are ordered last: the size bound of what is broadcast.
HOT_SHINGLES = 1 << 16
#: Bytes of text in which frequent shingles are looked for at a time.
HOT_SLICE = 8 << 20
#: Bytes of text whose sets are made at a time.
SET_SLICE = 1 << 20
#: Documents of one slice that hold a shingle before it is reported as frequent.
HOT_LOCAL = 3
#: Class keys that are broadcast at most; beyond it they are joined.
BROADCAST_KEYS = 500_000
#: Classes of over this share of all documents are joined by themselves: at most as many as its inverse.
HOT_SHARE = 1 / 1024
#: Sets that hold a shingle are counted up to this number.
MANY = 1 << 16
#: Merged lists and probes that a query holds at a time.
AT_ONCE = 1_000_000
#: Up to so many entries, lists are merged by a heap; longer ones by a run-merging sort.
HEAP_ENTRIES = 256
NULL_ID = -(1 << 63)


def required(a, b):
    """The least overlap of linked sets of sizes a and b: 100 * i >= 80 * (a + b - i)."""
    return -(-4 * (a + b) // 9)


def level(n):
    return 1 + n // 16


def posted(n):
    return n - -(-4 * n // 5) + level(n)


def sets_of(batch: pa.RecordBatch, k: int):
    """The shingle set of each text of a batch."""
    hashes, first = Texts.of(batch.column("text")).lowered().word_hashes()
    return shingles(hashes, first, k)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _classes(k: int):
    """Class of each document, and the frequent shingles of each slice (with a null doc)."""

    def run(batches):
        for batch in sliced(batches, most=HOT_SLICE):
            keys, sizes, seen, fresh = [], [], set(), []
            for s in (s for part in sliced([batch], most=SET_SLICE) for s in sets_of(part, k)):
                key = set_key(s) if len(s) else 0
                keys.append(key)
                sizes.append(len(s))
                if key not in seen:
                    seen.add(key)
                    fresh.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], ["doc", "key", "n"])
            if fresh:
                token, times = np.unique(np.concatenate(fresh), return_counts=True)
                hot = times >= HOT_LOCAL
                if hot.any():
                    yield pa.RecordBatch.from_arrays([pa.nulls(int(hot.sum()), pa.int64()), pa.array(token[hot].view(np.int64)), pa.array(times[hot])], ["doc", "key", "n"])

    return run


def _postings(k: int, hot: np.ndarray, rank: np.ndarray):
    """(token, key, n) of the posted shingles; a task posts equal sets once."""

    def run(batches):
        seen: set[int] = set()
        for batch in sliced(batches, most=SET_SLICE):
            tokens, keys, sizes = [], [], []
            for s in sets_of(batch, k):
                n = len(s)
                if not n or (key := set_key(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                if len(hot):
                    at = np.searchsorted(hot, s)
                    at[at == len(hot)] = 0
                    common = hot[at] == s
                    s = np.concatenate([s[~common], s[common][np.argsort(rank[at[common]], kind="stable")]])
                p = min(n, posted(n))
                tokens.append(s[:p])
                keys.append(np.full(p, key, np.int64))
                sizes.append(np.full(p, n, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))], ["token", "key", "n"])

    return run


def _lists(batches):
    """Rows of lists that hold another class of a size that can link; input sorted by token, n, key.

    Equal rows (copies posted by several tasks) come once.
    """
    held = None  # the last row seen, and whether it has been given out
    for batch in batches:
        if not batch.num_rows:
            continue
        t, k, n = (batch.column(c).to_numpy() for c in ("token", "key", "n"))
        if held is not None:
            t, k, n = np.append(held[0], t), np.append(held[1], k), np.append(held[2], n)
        given = held is not None and held[3]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])
        t, k, n = t[new], k[new], n[new]
        # the class nearest in size is next to it
        near = (t[1:] == t[:-1]) & (5 * n[:-1].astype(np.int64) >= 4 * n[1:].astype(np.int64))
        out = np.zeros(len(t), bool)
        out[1:] |= near
        out[:-1] |= near
        last = bool(out[-1]) or (given and len(t) == 1)
        if given:
            out[0] = False
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(k[out]), pa.array(n[out])], ["token", "key", "n"])
        held = (t[-1], k[-1], n[-1], last)


def _held(batches):
    """(token, key, n, held) of shingles in at least two sets; input sorted by token.

    ``held`` is the number of sets, ``MANY`` if there are as many or more, so that what is kept
    back of a list is bounded.
    """
    kept: list[tuple] = []  # rows of the last list while it is short
    token, size = None, 0
    columns = lambda t, k, n, h: pa.RecordBatch.from_arrays([pa.array(t), pa.array(k), pa.array(n), pa.array(h, pa.int32())], ["token", "key", "n", "held"])
    for batch in batches:
        if not batch.num_rows:
            continue
        t, k, n = (batch.column(c).to_numpy() for c in ("token", "key", "n"))
        edge = np.flatnonzero(t[1:] != t[:-1]) + 1
        first = edge[0] if len(edge) else len(t)
        if token is not None and t[0] != token:  # the list of the last batch has ended
            if size > 1 and kept:
                yield from (columns(*x, np.full(len(x[0]), min(size, MANY))) for x in kept)
            kept, size, token = [], 0, None
        size += first
        kept.append((t[:first], k[:first], n[:first]))
        token = t[0]
        if size >= MANY:
            yield from (columns(*x, np.full(len(x[0]), MANY)) for x in kept)
            kept = []
        if len(edge):
            if size > 1:
                yield from (columns(*x, np.full(len(x[0]), min(size, MANY))) for x in kept)
            last = edge[-1]
            length = np.diff(edge)
            held = np.repeat(np.minimum(length, MANY), length)
            more = held > 1
            if more.any():
                part = slice(first, last)
                yield columns(t[part][more], k[part][more], n[part][more], held[more])
            token, size, kept = t[-1], len(t) - last, [(t[last:], k[last:], n[last:])]
    if size > 1 and kept:
        yield from (columns(*x, np.full(len(x[0]), min(size, MANY))) for x in kept)


def _hub_edges(batches):
    """(a, b): each class of a list with the first whose size chains to it; input sorted by token, n, key."""
    last = None  # token, key, n and hub of the last row
    for batch in batches:
        if not batch.num_rows:
            continue
        t, k, n = (batch.column(c).to_numpy() for c in ("token", "key", "n"))
        if last is not None:
            t, k, n = np.append(last[0], t), np.append(last[1], k), np.append(last[2], n)
        chained = np.zeros(len(t), bool)
        chained[1:] = (t[1:] == t[:-1]) & (5 * n[:-1] >= 4 * n[1:])
        start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(t))))
        hub = k[start]
        if last is not None:
            hub[start == 0] = last[3]
        pairs = np.unique(np.stack([k, hub], 1)[k != hub], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        last = (t[-1], k[-1], n[-1], hub[-1])


def merged(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The members of sorted lists in order, and how many lists hold each."""
    if sum(map(len, runs)) <= HEAP_ENTRIES:
        found = [(one, sum(1 for _ in run)) for one, run in groupby(heapq.merge(*(r.tolist() for r in runs)))]
        return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
    flat = np.concatenate(runs)
    flat.sort(kind="stable")  # merges the runs
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[edge], np.diff(np.append(edge, len(flat)))


class Lists:
    """Inverted lists over the sets of a block."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], np.int64)
        self.total = len(sets)
        member = np.repeat(np.arange(self.total), self.n)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.tokens, place = np.unique(flat, return_inverse=True)
        #: place of a shingle times sets, plus set: sorted, so any list can be probed in it
        self.codes = np.sort(place * self.total + member)
        self.starts = np.searchsorted(self.codes, np.arange(len(self.tokens) + 1) * self.total)

    def search(self, query: np.ndarray, able: np.ndarray) -> np.ndarray:
        """Sets that link with the query set, of those that ``able`` admits (DivideSkip)."""
        n = len(query)
        able = able & (5 * self.n >= 4 * n) & (4 * self.n <= 5 * n)
        if not n or not able.any():
            return np.zeros(0, np.int64)
        place = np.searchsorted(self.tokens, query)
        place[place == len(self.tokens)] = 0
        place = place[self.tokens[place] == query]
        length = self.starts[place + 1] - self.starts[place]
        place = place[np.argsort(length, kind="stable")]
        # so many lists are long that a result is in at least level(n) of the short ones
        long = required(n, -(-4 * n // 5)) - level(n)
        short, long = place[: max(0, len(place) - long)], place[max(0, len(place) - long) :]
        runs = [self.codes[self.starts[t] : self.starts[t + 1]] - t * self.total for t in short.tolist()]
        runs = [r for r in (r[able[r]] for r in runs) if len(r)]
        if not runs:
            return np.zeros(0, np.int64)
        found, count = merged(runs)
        need = required(n, self.n[found])
        alive = count + len(long) >= need
        found, count, need = found[alive], count[alive], need[alive]
        step = max(1, AT_ONCE // max(1, len(long)))
        for at in range(0, len(found), step):
            codes = (long * self.total)[None, :] + found[at : at + step, None]
            there = np.searchsorted(self.codes, codes)
            there[there == len(self.codes)] = 0
            count[at : at + step] += (self.codes[there] == codes).sum(1)
        return found[count >= need]


def divide_skip(query: np.ndarray, candidates: list[np.ndarray]) -> np.ndarray:
    """Which candidate sets link with the query set (all sorted)."""
    found = Lists(candidates).search(query, np.ones(len(candidates), bool))
    return np.isin(np.arange(len(candidates)), found)


def _search_blocks(rows: pa.Table) -> pa.Table:
    """Links (a, b) that connect components: within a block (side 0 only), or between two.

    ``c`` names the component that a set is known to be in.  The links given out are
    one fewer than the components that they connect.
    """
    rows = rows.sort_by([("side", "ascending"), ("key", "ascending")])
    key, label, side = (rows.column(x).to_numpy() for x in ("key", "c", "side"))
    flat = rows.column("tokens").combine_chunks()
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
    sets = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    split = int((side == 0).sum())
    within = split == len(sets)
    base = 0 if within else split
    lists = Lists(sets[base:])
    label = np.unique(label, return_inverse=True)[1]
    open_ = len(np.unique(label))
    edges: list[tuple[int, int]] = []
    for q in range(split):
        if open_ == 1:
            break
        able = label[base:] != label[q]
        if within:
            able[:q] = False  # earlier queries have met this one
        near = base + lists.search(sets[q], able)
        others, example = np.unique(label[near], return_index=True)
        for other, e in zip(others.tolist(), near[example].tolist(), strict=True):
            edges.append((int(key[q]), int(key[e])))
            label[label == other] = label[q]
            open_ -= 1
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, c) of the classes that may link with one of another component."""
    placed = lists.join(labels.withColumnRenamed("v", "key"), "key", "left").select("token", "key", "n", F.coalesce("component", "key").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    return placed.join(mixed, "token", "left_semi").groupBy("key", "n", "c").agg(F.count(F.lit(1)).alias("held")).where("held >= 1 + floor(n / 20)").select("key", "c")


def _some(keys: DataFrame) -> tuple[DataFrame, bool]:
    """A table of few columns, marked for broadcast if its count allows it, and whether it is."""
    few = keys.count() <= BROADCAST_KEYS
    return (F.broadcast(keys) if few else keys), few


def _links(posted_: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links (a, b) of classes whose components are those of all links."""
    parts = shuffle_partitions(sets.sparkSession)
    sorted_ = lambda rows: rows.repartition(parts, "token").sortWithinPartitions("token", "n", "key")
    lists = cut(sorted_(posted_).mapInArrow(_lists, "token long, key long, n long"))
    enough = cut(lists.groupBy("key", "n").agg(F.count(F.lit(1)).alias("held")).where("held >= 1 + floor(n / 20)").select("key", "n"))
    some, few = _some(enough.select("key"))
    lists = lists.join(some, "key", "left_semi").select("token", "key", "n")
    lists = lists if few else sorted_(lists)  # a broadcast leaves lists as they lie
    groups = components(lists.mapInArrow(_hub_edges, "a long, b long").distinct())
    groups = cut(groups.join(enough, groups.v == enough.key).select("key", "n", F.col("component").alias("g")))
    sized = groups.groupBy("g").agg(F.sum(F.col("n") + 200).alias("size"))
    large = cut(sized.where(F.col("size") > block).select("g", F.ceil(F.col("size") / block).alias("blocks")))
    there = large.count()
    large, _ = _some(large)
    found = "a long, b long"
    filled = lambda rows: sets.select("key", "tokens").join(_some(rows)[0], "key")
    dealt = lambda rows, seed: rows.withColumn("i", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")))
    alone = lambda rows: filled(rows).withColumn("side", F.lit(0)).groupBy("g", "i").applyInArrow(_search_blocks, found)
    groups = groups.select("key", "g", F.col("key").alias("c"))
    links = alone(groups.join(large, "g", "left_anti").withColumn("i", F.lit(0).cast("long")))
    if not there:
        return cut(links)
    groups = cut(groups.join(large, "g"))
    links = cut(links.unionByName(alone(dealt(groups, 1))))
    left = groups.drop("c")
    links = cut(links.unionByName(alone(dealt(left.join(_open(lists, components(links)), "key"), 2))))
    left = cut(dealt(left.join(_open(lists, components(links)), "key"), 3))
    used = left.select("g", "i").distinct()
    meets = cut(used.join(used.select("g", F.col("i").alias("j")), "g").where("i <= j"))
    columns = ["g", "i", "j", "side", "key", "c", "tokens"]
    left = filled(left)
    near = left.join(meets, ["g", "i"]).withColumn("side", F.lit(0)).select(columns)
    far = left.withColumnRenamed("i", "j").join(meets.where("i < j"), ["g", "j"]).withColumn("side", F.lit(1)).select(columns)
    return cut(links.unionByName(near.unionByName(far).groupBy("g", "i", "j").applyInArrow(_search_blocks, found)))


def classes_and_links(docs: DataFrame, k: int = 5, block: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(doc, key, n) of each row, and links (a, b) of keys whose components are those of all links."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    first = cut(base.mapInArrow(_classes(k), "doc long, key long, n long"))
    members = first.where("doc IS NOT NULL")

    frequent = first.where("doc IS NULL").groupBy("key").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "key").limit(HOT_SHINGLES).toArrow()
    hot = frequent.column("key").to_numpy().view(np.uint64)
    order = np.argsort(hot)
    rank = np.argsort(np.argsort(frequent.column("times").to_numpy(), kind="stable"))[order]

    postings = base.select("text").mapInArrow(_postings(k, hot[order], rank), "token long, key long, n int")
    lists = postings.repartition(parts, "token").sortWithinPartitions("token", "n", "key").mapInArrow(_lists, "token long, key long, n int")
    able = lists.groupBy("key", "n").agg(F.count(F.lit(1)).alias("held")).where("held >= 1 + floor(n / 20)").select("key")
    # one document of each class that may link, to make the set of its text again
    named = members.where("n > 0").groupBy("key").agg(F.min("doc").alias("doc"))
    wanted = cut(named.join(able, "key", "left_semi").select("doc", "key"))
    texts = base.join(_some(wanted)[0], "doc")

    def remake(batches):
        for batch in sliced(batches, most=SET_SLICE):
            keys, sizes, made = [], [], []
            # rows that share a doc_id may be of several classes: the one that is meant stays
            for key, s in zip(batch.column("key").to_pylist(), sets_of(batch, k), strict=True):
                if len(s) and set_key(s) == key:
                    keys.append(key)
                    sizes.append(len(s))
                    made.append(s)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(made).view(np.int64) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["key", "n", "tokens"])

    sets = cut(texts.mapInArrow(remake, "key long, n long, tokens array<long>"))
    if sets.count() > wanted.count():  # equal rows of one document
        sets = cut(sets.groupBy("key", "n").agg(F.first("tokens").alias("tokens")))

    # the second order: by the number of sets that hold a shingle; rare ones come before all these
    each = sets.select(F.explode("tokens").alias("token"), "key", "n").repartition(parts, "token").sortWithinPartitions("token")
    shared = each.mapInArrow(_held, "token long, key long, n long, held int")
    shared = shared.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    n, width = F.col("n"), F.size("shared")
    post = F.least(n, n - F.ceil(4 * n / 5) + 1 + F.floor(n / 16)) - (n - width)
    shared = shared.withColumn("posted", F.slice("shared", F.lit(1), F.greatest(F.lit(0), post).cast("int"))).where("size(posted) >= 1 + floor(n / 20)")
    return members, _links(shared.select(F.explode("posted.token").alias("token"), "key", "n"), sets, block)


def _attached(members: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """``members`` left-joined to ``named(key, rows, ...)``; classes of many rows are never gathered in a task."""
    if named.count() <= BROADCAST_KEYS:
        return members.join(F.broadcast(named.drop("rows")), "key", "left")
    hot = F.broadcast(named.where(F.col("rows") > HOT_SHARE * total))
    often = members.join(hot.drop("rows"), "key")
    rest = members.join(hot.select("key"), "key", "left_anti").join(named.drop("rows"), "key", "left")
    return often.unionByName(rest)


def join_documents(docs: DataFrame, k: int = 5, block: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of each row of ``docs(doc_id, text)``."""
    members, links = classes_and_links(docs, k, block)
    full = members.where("n > 0")
    classes = full.groupBy("key").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("rows"))
    # the classes of one document are connected
    several = cut(full.groupBy("doc").agg(F.min("key").alias("b"), F.max("key").alias("most")).where("b <> most").select("doc", "b"))
    several, _ = _some(several)
    links = links.unionByName(full.join(several, "doc").select(F.col("key").alias("a"), "b").where("a <> b").distinct())
    labels = components(links)
    placed = classes.join(labels.withColumnRenamed("v", "key"), "key", "left")
    # classes of one row that link with nothing are their own component
    placed = cut(placed.where("rows > 1 OR component IS NOT NULL").select("key", "rows", "class_id", F.coalesce("component", "key").alias("c")))
    heads = placed.groupBy("c").agg(F.min("class_id").alias("component_id"))
    named = cut(placed.join(heads, "c").select("key", "rows", "class_id", "component_id"))
    back = lambda c: F.when(c != NULL_ID, c)
    return _attached(members, named, members.count()).select(
        back(F.col("doc")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        back(F.coalesce("component_id", "doc")).alias("component_id"),
        back(F.coalesce("class_id", "doc")).alias("class_id"),
    )
