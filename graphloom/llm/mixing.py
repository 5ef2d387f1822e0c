"""Operator 1 [native]: mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a hashed, repeatable shuffle, once per pass
over the source.  Documents are served in packets of at most ``quantum`` words.  A
packet's virtual finish time is the source's cumulated words up to its end, divided
by the source's target.  All packets of all sources are range-sorted by it, cumulated
in that order, and truncated where the total budget is spent; the packet at the cut
gives its leading words.  So a document is taken whole, by its leading words or not at
all, the words taken sum to the budget, and each source is within a packet or so of
its target.

Targets share ``budget`` times all words in proportion to the weights 5, 2, 1,
repeating over the sources in code-point order (null last); a target stops at
``most`` times its source's words and the excess is reshared by weight.  That
fixpoint is ``min(most * size, level * weight)``, found by one sorted pass over the
sources.

Prefix sums are two-level: over the buckets of a source's queue, then within a bucket,
so that a source with a third of all rows is spread over many tasks; over ranges of
finish time, then within a range.  Sizes are computed once and kept in the shared
folder.  The table of sources is broadcast only if it counts at most
``BROADCAST_SOURCES`` rows; otherwise it is joined by shuffle.

Null texts have no words and are never taken; sources of no words have target 0;
packets of equal finish time go by source, pass and shuffle; repeated rows are queued
each by itself, ordered by a text hash; a long text is as many packets as it takes; an
empty table gives no rows.  Other columns are passed on by ``mix``, whatever their
names are (those that begin with ``__mix_`` excepted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BROADCAST_SOURCES = 10_000
#: Documents of one source that a window sorts at a time, on average.
BUCKET_ROWS = 2_000
#: Packets of a range of finish times, on average.
RANGE_ROWS = 20_000


def n_passes(most: float) -> int:
    """How often a source may be gone through to reach ``most`` times its size."""
    return int(-(-most // 1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target) from ``sizes(source, size)``.

    Sources are few rows after the aggregation, so global windows are used here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    everything = Window.partitionBy()
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("total", budget * F.sum("source_size").over(everything))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onward = ranked.rowsBetween(0, Window.unboundedFollowing)
    # if all sources with a smaller ratio are capped, the others are filled to this level
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    fits = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return per.select("source", "source_size", "source_rows", "weight", F.least(F.col("cap"), F.coalesce(fits * F.col("weight"), F.col("cap"))).alias("target"))


def served(docs: DataFrame, budget: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, quantum: int = 64) -> DataFrame:
    """One row per document and pass: (doc_id, text_hash, source, pass, size, source_size, target, words, finish_time).

    ``words`` are the leading words that the mix takes of the document in that
    pass, ``finish_time`` is its virtual finish time.
    """
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    sizes = cut(sizes)
    sources = cut(source_targets(sizes, budget, most, weights))
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    passes = n_passes(most)
    n_packets = F.greatest(F.ceil(F.col("size") / quantum), F.lit(1))
    total, packets = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(n_packets), F.lit(0))).first()
    rows = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).drop(sources.source)
    rows = rows.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
    # a hash of 60 bits that SQL can make too; buckets are ranges of it
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    buckets = F.ceil(F.col("source_rows") / BUCKET_ROWS)
    rows = rows.withColumn("place", place).withColumn("bucket", F.floor(F.shiftright("place", 30) * buckets / (1 << 30)))
    # totals of the buckets before this one, in the order (pass, bucket)
    totals = rows.groupBy("source", "pass", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    totals = totals.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("bucket").alias("b"), "ahead")
    within = Window.partitionBy("source", "pass", "bucket").orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    rows = rows.join(totals, rows.source.eqNullSafe(totals.s) & (rows["pass"] == totals.p) & (rows.bucket == totals.b))
    rows = rows.withColumn("start", F.col("ahead") + F.col("upto") - F.col("size"))
    # the packets, in ranges of their finish times
    rows = rows.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), n_packets - 1)))
    served_ = F.least((F.col("packet") + 1) * quantum, F.col("size"))
    rows = rows.withColumn("words", served_ - F.col("packet") * quantum)
    rows = rows.withColumn("finish", F.when(F.col("target") > 0, (F.col("start") + served_) / F.col("target")))
    ranges = max(1, -(-packets * passes // RANGE_ROWS))
    # what has no target has no finish time and no words: it is spread
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("finish") * ranges), -1 - F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(ranges))))
    rows = rows.select("doc_id", "text_hash", "source", "pass", "size", "source_size", "target", "place", "packet", "words", "finish", "range")
    before = rows.groupBy("range").agg(F.sum("words").alias("in_range"))
    before = before.select(F.col("range").alias("r"), F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    order = ["finish", F.col("source").asc_nulls_last(), "pass", "place", "doc_id", "text_hash", "packet"]
    rows = rows.withColumn("upto", F.sum("words").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(before, rows.range == before.r)
    left = F.lit(int(min(budget, most) * total)) - (F.col("earlier") + F.col("upto") - F.col("words"))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long")
    return rows.groupBy("doc_id", "text_hash", "source", "pass").agg(
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum(taken).alias("words"),
        F.sum(F.when(F.col("packet") == 0, 1).otherwise(0)).alias("copies"),
        F.max("finish").alias("finish_time"),
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: the words that the mix takes of it, in the order of service."""
    per = served(docs, **options).groupBy("doc_id", "text_hash", "source").agg(
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum("words").alias("taken"),
        F.min("finish_time").alias("first_finish"),
        F.max("copies").cast("int").alias("copies"),
    )
    # equal rows are told apart by their number among equals
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    share = F.floor((F.col("taken") + F.col("copies") - F.col("copy")) / F.col("copies")).cast("long")
    out = per.select("doc_id", "size", "source_size", "target", share.alias("taken"), "first_finish")
    return out.repartitionByRange(F.col("first_finish").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_finish").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` once per pass that takes them, the text cut to the words taken.

    Documents taken whole keep their text as it is.
    """
    # equal rows follow each other in the queue: the words taken of them fill one copy after the other
    rows = served(docs, **options).where("words > 0").select("doc_id", "text_hash", "source", F.col("pass").alias("__mix_pass"), F.col("words").alias("__mix_total"), F.col("size").alias("__mix_size"))
    text = F.col("text").cast("string")
    # null-safe keys as plain ones, so that the window below needs no shuffle of its own
    keys = lambda doc_id, text_hash, source: [
        F.coalesce(doc_id, F.lit(0)).alias("__mix_id"), doc_id.isNull().alias("__mix_no_id"), text_hash.alias("__mix_hash"),
        F.coalesce(source, F.lit("")).alias("__mix_source"), source.isNull().alias("__mix_no_source"),
    ]
    names = ["__mix_id", "__mix_no_id", "__mix_hash", "__mix_source", "__mix_no_source"]
    rows = rows.select(*keys(F.col("doc_id"), F.col("text_hash"), F.col("source")), "__mix_pass", "__mix_total", "__mix_size")
    joined = docs.select("*", *keys(F.col("doc_id").cast("long"), F.xxhash64(text), F.col("source").cast("string"))).join(rows, names)
    copy = F.row_number().over(Window.partitionBy(*names, "__mix_pass").orderBy(F.lit(0))) - 1
    words = F.least(F.col("__mix_size"), F.col("__mix_total") - copy * F.col("__mix_size"))
    joined = joined.withColumn("__mix_words", words).where("__mix_words > 0")
    # white space before a word goes with it
    runs = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    lead = F.array_join(F.slice(runs, F.lit(1), F.col("__mix_words").cast("int")), "")
    keep = F.when(F.col("__mix_words") < F.col("__mix_size"), lead).otherwise(text)
    return joined.select(*[keep.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
