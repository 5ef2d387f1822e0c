"""Operator 11: the prefix trie of conversations.

The digest of a conversation's first d turns is the exclusive or of hashes of its
turns and their places, twice 64 bits, so digests of all prefixes are running totals.
The smallest conversation that holds a prefix owns that node.  Who owns a node owns all
of its own deeper ones, so each conversation has a first owned depth, found by binary
search: in each round all open conversations probe the digest of their middle depth in
the table of digest minima, in one batched join.  Owned depths are a chain; the last
probe that failed names the owner of the node on which the chain hangs.  Totals of
subtrees are summed bottom-up over chains, doubling the distance each round, so the
rounds grow with the logarithm of the height; within a chain they are suffix sums.

No conversation and no node is gathered in one task: turns are numbered by blocks of
a range sort, running totals go by blocks of ``STEP`` depths with carries between
blocks, and the ids that end in a node are hashed as a stream of short runs.

Null roles and texts are empty; a null turn comes first; turns of equal number follow
each other by their digest, so repeated rows are turns of their own; rows without a
conv_id are no conversation; very long texts are hashed whole; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import cut, discard, shared_dir, shuffle_partitions, stored

#: Depths in a block of running totals; ids in a run of the stream that is hashed.
STEP, RUN = 1 << 16, 512
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["conv", "depth"]
NO_ENDS = hashlib.sha256().hexdigest()


class Scratch:
    """Tables of one run in the shared folder; bucketed ones are joined on their columns without moving."""

    def __init__(self, spark: SparkSession):
        self.spark, self.parts, self.paths, self.names = spark, shuffle_partitions(spark), [], []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        self.paths.append(path)
        return df

    def bucketed(self, df: DataFrame, *keys: str) -> DataFrame:
        name = f"trie_{uuid.uuid4().hex}"
        self.paths.append(f"{shared_dir(self.spark)}/{name}")
        self.names.append(name)
        df.repartition(self.parts, *keys).write.bucketBy(self.parts, *keys).sortBy(*keys).option("path", self.paths[-1]).saveAsTable(name)
        return self.spark.table(name)

    def clear(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            discard(self.spark, path)


def numbered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, j, digest, words): the turns of each conversation by number, from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    sorted_ = turns.repartitionByRange(scratch.parts, "conv", *order, F.monotonically_increasing_id())
    turns = scratch.keep(sorted_.withColumn("block", F.spark_partition_id()), "turns")
    counts = turns.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv", "block").orderBy(*order)
    return scratch.keep(turns.join(before, ["conv", "block"]).select("conv", (F.col("before") + F.row_number().over(within) - 1).alias("j"), "digest", "words"), "numbered")


def as_they_are(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (conv, len) and their turns (conv, depth, digest, words) from depth 1."""
    members = scratch.keep(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("len")), "members")
    return members, turns.select("conv", (F.col("j") + 1).alias("depth"), "digest", "words")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """As ``as_they_are``, where a conversation c starts with the first h turns of c - c % 20 in place of its own."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.where("conv % 20 = 0").select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    wide = sizes.withColumn("base", F.col("conv") - F.col("conv") % 20).join(bases, "base", "left")
    taken = F.least(h, F.coalesce("base_n", F.lit(0)))
    members = scratch.keep(wide.select("conv", "base", h.alias("h"), taken.alias("taken"), (taken + F.greatest(F.col("n") - h, F.lit(0))).alias("len")), "members")
    own = turns.where(F.col("j") >= h).join(members.select("conv", "taken"), "conv").select("conv", (F.col("j") - h + F.col("taken") + 1).alias("depth"), "digest", "words")
    heads = turns.where("conv % 20 = 0 AND j < 3").withColumnRenamed("conv", "base")
    taken_rows = members.where("h > 0").select("conv", "base", "h").join(heads, "base").where("j < h").select("conv", (F.col("j") + 1).alias("depth"), "digest", "words")
    return members.select("conv", "len"), own.unionByName(taken_rows)


def running(rows: DataFrame, totals: dict[str, tuple], deeper: bool = False) -> DataFrame:
    """Running totals over the depths of each conversation: ``totals`` has an aggregate, its column and nothing's value by name.

    With ``deeper`` they run from the deepest up.
    """
    rows = rows.withColumn("block", F.expr(f"depth div {STEP}"))
    sums = rows.groupBy("conv", "block").agg(*[f(c).alias(n) for n, (f, c, _) in totals.items()])
    order = F.desc if deeper else F.asc
    others = Window.partitionBy("conv").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv", "block", *[f(n).over(others).alias(f"carry_{n}") for n, (f, _, _) in totals.items()])
    within = Window.partitionBy("conv", "block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carry, ["conv", "block"])

    def both(name, f, column, zero):
        here, before = f(column).over(within), F.coalesce(f"carry_{name}", F.lit(zero))
        return here.bitwiseXOR(before) if f is F.bit_xor else here + before

    made = joined.select(*rows.columns, *[both(n, *t).alias(f"all_{n}") for n, t in totals.items()])
    return made.drop("block")


def first_owned(members: DataFrame, prefixes: DataFrame, minima: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, len, first, owner): the first depth that each conversation owns, len + 1 if none, and the owner one depth above it.

    The owner is null above depth 1: all hang on the root.
    """
    state = members.select("conv", "len", F.lit(1).cast("long").alias("first"), (F.col("len") + 1).alias("last"), F.lit(None).cast("long").alias("owner"))
    longest = members.agg(F.max("len")).head()[0] or 0
    for _ in range(int(longest).bit_length()):
        probes = state.where("first < last").withColumn("depth", F.floor((F.col("first") + F.col("last")) / 2))
        found = probes.join(prefixes, NODE).join(minima.select("depth", "low", "high", F.col("conv").alias("least")), ["depth", "low", "high"])
        won = F.col("least") == F.col("conv")
        moved = found.select(
            "conv", "len", F.when(won, F.col("first")).otherwise(F.col("depth") + 1).alias("first"), F.when(won, F.col("depth")).otherwise(F.col("last")).alias("last"), F.when(won, F.col("owner")).otherwise(F.col("least")).alias("owner")
        )
        state = scratch.keep(moved.unionByName(state.where("first >= last")), "owned")
    return state.select("conv", "len", "first", "owner")


def subtree_totals(chains: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(conv, leaves, saved) of each chain with all chains below it; ``chains`` has its own and its parent ``above``.

    After round k a chain holds the totals of chains less than 2 ** k below it, and
    ``above`` is its ancestor at that distance.
    """
    state = chains.select("conv", "above", "leaves", "saved")
    while state.where("above IS NOT NULL").limit(1).count():
        up = state.where("above IS NOT NULL").groupBy(F.col("above").alias("conv")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        summed = state.join(up, "conv", "left").select("conv", "above", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        # nothing is above the root, on which many chains hang
        open_, done = summed.where(F.col("above") != root), summed.where(F.col("above").isNull() | (F.col("above") == root))
        jump = state.select(F.col("conv").alias("above"), F.col("above").alias("next"))
        stepped = open_.join(jump, "above").select("conv", F.col("next").alias("above"), "leaves", "saved")
        state = scratch.keep(stepped.unionByName(done.withColumn("above", F.lit(None).cast("long"))), "totals")
    return state.select("conv", "leaves", "saved")


def _runs(batches):
    """Comma-joined runs of the sorted ids of each node."""
    for batch in batches:
        nodes = list(zip(batch.column("conv").to_pylist(), batch.column("depth").to_pylist(), strict=True))
        ids = batch.column("member").to_pylist()
        out, lo = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or nodes[i] != nodes[lo] or i - lo == RUN:
                out.append((*nodes[lo], ids[lo], ",".join(map(str, ids[lo:i]))))
                lo = i
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())], ["conv", "depth", "member", "run"])


def _digested(batches):
    """SHA-256 of the runs of each node, which follow each other."""
    node, state = None, None
    schema = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for c, d, run in zip(batch.column("conv").to_pylist(), batch.column("depth").to_pylist(), batch.column("run").to_pylist(), strict=True):
            if (c, d) != node:
                if node:
                    out.append({"conv": node[0], "depth": node[1], "ends_sha256": state.hexdigest()})
                node, state = (c, d), hashlib.sha256(run.encode())
            else:
                state.update(b"," + run.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if node:
        yield pa.RecordBatch.from_pylist([{"conv": node[0], "depth": node[1], "ends_sha256": state.hexdigest()}], schema)


def end_digests(ends: DataFrame, parts: int) -> DataFrame:
    """SHA-256 of the comma-joined ``member`` ids of each node, in ascending order."""
    runs = ends.repartitionByRange(parts, *NODE, "member").sortWithinPartitions(*NODE, "member").mapInArrow(_runs, "conv long, depth long, member long, run string")
    return runs.repartition(parts, *NODE).sortWithinPartitions(*NODE, "member").mapInArrow(_digested, "conv long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, make=as_they_are) -> DataFrame:
    """The nodes of the trie of ``conversations(conv_id, turn, role, text)``, whose members ``make`` gives.

    conv_id (the smallest member), depth, parent_conv_id, n_convs (members), n_ends
    (members without further turns), n_children, n_leaves, saved_tokens (words of a
    node's last text that members after the first repeat, summed over the subtree) and
    ends_sha256.
    """
    scratch = Scratch(conversations.sparkSession)
    try:
        members, turns = make(numbered(conversations, scratch), scratch)
        root, everyone = members.agg(F.min("conv"), F.count(F.lit(1))).head()
        digests = {n: (F.bit_xor, F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")), 0) for seed, n in ((1, "low"), (2, "high"))}
        prefixes = running(turns, digests).select("conv", "depth", "words", F.col("all_low").alias("low"), F.col("all_high").alias("high"))
        prefixes = scratch.bucketed(prefixes, "conv", "depth")
        minima = prefixes.groupBy("depth", "low", "high").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
        minima = scratch.bucketed(minima, "depth", "low", "high")
        owned = scratch.keep(first_owned(members, prefixes.drop("words"), minima, scratch), "chains")
        above = F.when(F.col("conv") == F.lit(root), F.lit(None)).otherwise(F.coalesce("owner", F.lit(root))).cast("long")
        # the root's owner owns depth 0 as well
        top = F.when(F.col("conv") == F.lit(root), F.lit(0)).otherwise(F.col("first")).cast("long")
        chains = owned.where((F.col("first") <= F.col("len")) | (F.col("conv") == F.lit(root))).select("conv", "len", above.alias("above"), top.alias("top"))
        own = minima.select("conv", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
        nodes = own.unionByName(members.sparkSession.range(0 if root is None else 1).select(F.lit(root).cast("long").alias("conv"), F.col("id").alias("depth"), F.lit(everyone).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved")))
        hung = chains.where("above IS NOT NULL").select(F.col("above").alias("conv"), (F.col("top") - 1).alias("depth"), F.col("conv").alias("child"))
        kids = hung.groupBy(*NODE).agg(F.count(F.lit(1)).alias("kids"))
        tips = chains.select("conv", F.col("len").alias("depth"))
        bare = tips.join(kids, NODE, "left_anti").select("conv", F.lit(1).cast("long").alias("leaves"))
        spent = own.groupBy("conv").agg(F.sum("saved").alias("saved"))
        single = chains.join(spent, "conv", "left").join(bare, "conv", "left").select("conv", "above", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
        totals = subtree_totals(scratch.keep(single, "single"), root or 0, scratch)
        # what each node has besides its own: children that are tops of chains, the mark of a tip and of a top
        none = F.lit(None).cast("long")
        marks = (
            hung.join(totals.withColumnRenamed("conv", "child"), "child")
            .select(*NODE, F.lit(1).cast("long").alias("kids"), "leaves", F.col("saved").alias("below"), none.alias("tip"), none.alias("is_top"), none.alias("parent"))
            .unionByName(tips.select(*NODE, none.alias("kids"), none.alias("leaves"), none.alias("below"), F.lit(1).cast("long").alias("tip"), none.alias("is_top"), none.alias("parent")))
            .unionByName(chains.select("conv", F.col("top").alias("depth"), none.alias("kids"), none.alias("leaves"), none.alias("below"), none.alias("tip"), F.lit(1).cast("long").alias("is_top"), F.col("above").alias("parent")))
        )
        marks = marks.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "below")], *[F.max(c).alias(c) for c in ("tip", "is_top", "parent")])
        full = nodes.join(marks, NODE, "left").select(
            *NODE,
            "n_convs",
            F.when(F.col("is_top").isNull(), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
            (F.coalesce("kids", F.lit(0)) + F.when(F.col("tip").isNull(), 1).otherwise(0)).alias("n_children"),
            F.coalesce("leaves", F.lit(0)).alias("leaves"),
            (F.col("saved") + F.coalesce("below", F.lit(0))).alias("saved"),
        )
        full = full.withColumn("leaves", F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
        full = running(full, {"leaves": (F.sum, F.col("leaves"), 0), "saved": (F.sum, F.col("saved"), 0)}, deeper=True)
        holder = F.when((F.col("first") <= F.col("len")), F.col("conv")).otherwise(F.coalesce("owner", F.lit(root)))
        ends = owned.select(holder.cast("long").alias("node"), F.col("len").alias("depth"), F.col("conv").alias("member")).withColumnRenamed("node", "conv")
        counts = ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_ends"))
        final = full.join(end_digests(ends, scratch.parts), NODE, "left").join(counts, NODE, "left")
        return cut(
            final.select(
                F.col("conv").alias("conv_id"),
                "depth",
                "parent_conv_id",
                "n_convs",
                F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"),
                F.col("n_children").cast("long").alias("n_children"),
                F.col("all_leaves").cast("long").alias("n_leaves"),
                F.col("all_saved").cast("long").alias("saved_tokens"),
                F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
            )
        )
    finally:
        scratch.clear()
