"""Splitters (P1-P7): chunks to smaller chunks."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from graphloom.functions.models import model
from graphloom.functions.text import hash_id
from graphloom.session import cut

#: What ends a sentence.
ENGLISH_ENDS, OTHER_ENDS = ".。？?！!\n", "。？！\n"
#: Sections that a task passes on at a time.
CUTS = 4096


def sentences(text: Column, english: bool = True) -> Column:
    """Cut after each delimiter, trimmed, blanks dropped."""
    ends = re.escape(ENGLISH_ENDS if english else OTHER_ENDS)
    found = F.regexp_extract_all(text, F.lit(f"[^{ends}]*[{ends}]|[^{ends}]+$"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def capped(parts: Column, most: int) -> Column:
    """Parts of over ``most`` characters are cut there."""
    pieces = F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most)), lambda i: F.substr(s, i.cast("int") * most + 1, F.lit(most))))
    return F.flatten(pieces)


def packed(parts: Column, size: int, window: int) -> Column:
    """Sentences greedily packed up to ``size`` characters.

    The next chunk starts with the trailing sentences of the last one, as many as it
    takes to reach ``window`` characters; they count towards its size.  A longer
    sentence is a chunk by itself.  Only lengths and places are folded, and texts are
    joined once, so the work is linear in the text.
    """
    lengths = F.transform(parts, lambda x: F.length(x))
    numbered = F.transform(parts, lambda x, i: F.struct(i.alias("i"), F.length(x).alias("n")))
    none = F.struct(F.lit(0).alias("count"), F.lit(0).alias("chars"))
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("chars"), F.array().cast("array<struct<first:int,stop:int>>").alias("cuts"))

    def tail(s, x):
        """The sentences before x that it is carried with: none if they leave it no room."""
        if window <= 0:
            return none
        back = F.reverse(F.slice(lengths, s["first"] + 1, x["i"] - s["first"]))
        got = F.aggregate(back, none, lambda t, n: F.when(t["chars"] >= window, t).otherwise(F.struct((t["count"] + 1).alias("count"), (t["chars"] + n).alias("chars"))))
        return F.transform(F.array(got), lambda t: F.when(t["chars"] + x["n"] > size, none).otherwise(t))[0]

    def step(s, x):
        cut_here = lambda t: F.struct((x["i"] - t["count"]).alias("first"), (t["chars"] + x["n"]).alias("chars"), F.concat(s["cuts"], F.array(F.struct(s["first"].alias("first"), x["i"].alias("stop")))).alias("cuts"))
        full = (x["i"] > s["first"]) & (s["chars"] + x["n"] > size)
        return F.when(full, F.transform(F.array(tail(s, x)), cut_here)[0]).otherwise(F.struct(s["first"].alias("first"), (s["chars"] + x["n"]).alias("chars"), s["cuts"].alias("cuts")))

    last = lambda s: F.when(F.size(parts) > 0, F.concat(s["cuts"], F.array(F.struct(s["first"].alias("first"), F.size(parts).alias("stop"))))).otherwise(s["cuts"])
    return F.transform(F.aggregate(numbered, start, step, last), lambda c: F.array_join(F.slice(parts, c["first"] + 1, c["stop"] - c["first"]), ""))


def _numbered(chunks: DataFrame, pieces: Column) -> DataFrame:
    """Piece 0 keeps the parent's id, others hash ``id#k``."""
    keep = [c for c in chunks.columns if c not in ("id", "name", "content", "_parts")]
    rows = chunks.select("id", "name", *keep, F.posexplode(pieces).alias("k", "piece"))
    return rows.select(
        F.when(F.col("k") == 0, F.col("id")).otherwise(hash_id(F.concat_ws("#", "id", F.col("k").cast("string")))).alias("id"),
        F.concat("name", F.lit("_split_"), F.col("k").cast("string")).alias("name"), F.col("piece").alias("content"), F.col("id").alias("parent_id"), *[c for c in keep if c != "parent_id"],
    )


def by_sentences(chunks: DataFrame, size: int = 500, window: int = 100, english: bool = True) -> DataFrame:
    """P1, P2 on ``chunks(id, name, content)``."""
    return _numbered(chunks.withColumn("_parts", capped(sentences(F.col("content"), english), 2 * size)), packed(F.col("_parts"), size, window))


def by_length(chunks: DataFrame, size: int, window: int) -> DataFrame:
    """Fixed windows every ``size - window`` characters."""
    if window >= size:
        raise ValueError("the window must be smaller than the size")
    step = size - window
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(step))
    pieces = F.transform(starts, lambda s: F.substr(F.col("content"), s + 1, F.lit(size)))
    rows = chunks.select("id", "name", F.posexplode(pieces).alias("k", "content"))
    return rows.select(hash_id(F.concat_ws("#", "id", F.col("k").cast("string"))).alias("id"), F.concat("name", F.lit("_split_"), F.col("k").cast("string")).alias("name"), "content", F.col("id").alias("parent_id"), "k")


def markdown_table(content: Column, size: int) -> Column:
    """Header and rule repeated over rows packed up to ``size`` characters; lines before and after repeat too."""
    lines = F.split(content, "\n")
    is_row = lambda x: F.trim(x).startswith("|")
    rows = F.filter(lines, is_row)
    head = F.array_join(F.slice(rows, 1, 2), "\n")
    first = F.array_position(F.transform(lines, is_row), True)
    before = F.array_join(F.slice(lines, F.lit(1), F.greatest(first.cast("int") - 1, F.lit(0))), "\n")
    last = first.cast("int") + F.size(rows)
    after = F.array_join(F.slice(lines, F.greatest(last, F.lit(1)), F.greatest(F.size(lines) - last + 1, F.lit(0))), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    body = F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0)))

    def step(s, x):
        full = (s["now"] != "") & (F.length(s["now"]) + F.length(x) > size)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(full | (s["now"] == ""), x).otherwise(F.concat_ws("\n", s["now"], x)).alias("now"),
        )

    parts = F.aggregate(body, start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
    full = lambda p: F.array_join(F.filter(F.array(before, head, p, after), lambda x: x != ""), "\n")
    return F.when((F.length(content) <= size) | (F.size(rows) < 3), F.array(content)).otherwise(F.transform(parts, full))


def split_tables(chunks: DataFrame, size: int) -> DataFrame:
    return _numbered(chunks, markdown_table(F.col("content"), size))


def by_pattern(chunks: DataFrame, pattern: str, name_group: int, content_group: int, header_group: int | None = None, size: int | None = None) -> DataFrame:
    """P5: regex groups to name and content (after the header); long contents are cut again with a quarter's overlap."""
    groups = {"name": name_group, "body": content_group} | ({"header": header_group} if header_group is not None else {})
    found = F.arrays_zip(*[F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()])
    rows = chunks.select(F.col("id").alias("parent_id"), F.posexplode(found).alias("k", "m"))
    content = F.concat_ws("\n", F.col("m.header"), F.col("m.body")) if header_group is not None else F.col("m.body")
    rows = rows.select(hash_id(F.concat_ws("#", "parent_id", F.col("k").cast("string"))).alias("id"), F.col("m.name").alias("name"), content.alias("content"), "parent_id", "k")
    return rows if size is None else by_length(rows.select("id", "name", "content"), size, size // 4)


def by_offsets(chunks: DataFrame, offsets: str = "offsets") -> DataFrame:
    """A model's ascending starts ``offsets(array<struct<at int, abstract string>>)`` to slices."""
    marks = F.col(offsets)
    rows = chunks.select("id", "content", F.posexplode(marks).alias("k", "m"), F.transform(marks, lambda m: m["at"]).alias("ats"))
    end = F.coalesce(F.try_element_at("ats", F.col("k") + 2), F.length("content"))
    return rows.select(hash_id(F.concat_ws("#", "id", F.col("k").cast("string"))).alias("id"), F.col("m.abstract").alias("name"), F.substr(F.col("content"), F.col("m.at") + 1, end - F.col("m.at")).alias("content"), F.col("id").alias("parent_id"))


def by_meaning(chunks: DataFrame, size: int, model_name: str = "cuts") -> DataFrame:
    """A model's cuts of ``chunks(id, name, content)``, again while a piece has ``size`` characters or more.

    A piece for which the model names no place inside stays whole, whatever its
    length; so every round makes pieces shorter and the loop ends.  What lies before
    the first cut is a piece too.
    """
    cuts = lambda text: F.array_sort(F.array_distinct(F.filter(model(model_name)(text), lambda m: (m["at"] > 0) & (m["at"] < F.length(text)))))
    done, level = None, chunks.select("id", "name", "content", F.col("id").alias("parent_id"))
    while True:
        level = cut(level.withColumn("offsets", F.when(F.length("content") >= size, cuts(F.col("content")))))
        inside = F.coalesce(F.size("offsets"), F.lit(0)) > 0
        kept = level.where(~inside).drop("offsets")
        done = kept if done is None else done.unionByName(kept)
        level = level.where(inside)
        if not level.limit(1).count():
            return done
        head = F.array(F.struct(F.lit(0).alias("at"), F.col("name").alias("abstract")))
        level = by_offsets(level.withColumn("offsets", F.concat(head, F.transform("offsets", lambda m: F.struct(m["at"].alias("at"), m["abstract"].alias("abstract"))))))


# outlines (P7)


def heading_level(title: Column) -> Column:
    """P7d: chapter or part 1, section 2, article 3; others 0."""
    return (
        F.when(title.rlike("^\\s*第.{1,6}[章篇部]|(?i)^\\s*(chapter|part)\\b"), 1)
        .when(title.rlike("^\\s*第.{1,6}节|(?i)^\\s*section\\b"), 2)
        .when(title.rlike("^\\s*第.{1,6}条|(?i)^\\s*article\\b"), 3)
        .otherwise(0)
    )


def unified_levels(titles: DataFrame) -> DataFrame:
    """P7e: the first level seen for a heading keyword of a document holds for all."""
    keyed = titles.withColumn("keyword", F.regexp_extract("title", r"^\s*(\p{L}+)", 1))
    first = keyed.groupBy("doc_id", "keyword").agg(F.min_by("level", "pos").alias("first_level"))
    return keyed.join(first, ["doc_id", "keyword"]).withColumn("level", F.col("first_level")).drop("first_level", "keyword")


def _cuts(content: str, titles: list[dict]) -> list[tuple]:
    """(pos, title, level, section) of the titles that count, in one pass over the text.

    An automaton of the distinct titles tells where each occurs first.
    """
    import ahocorasick

    first: dict[str, int] = {"": 1}
    automaton = ahocorasick.Automaton()
    for title in {x["title"] for x in titles} - {None, ""}:
        automaton.add_word(title, title)
    if len(automaton):
        automaton.make_automaton()
        for last, title in automaton.iter(content):
            first.setdefault(title, last - len(title) + 2)
    found: list[tuple] = []
    for x in titles:
        pos = first.get(x["title"], 0)
        if pos > (found[-1][0] if found else 0):
            found.append((pos, x["title"], x["level"]))
    ends = [pos for pos, _, _ in found[1:]] + [len(content) + 1]
    return [(*x, content[x[0] - 1 : end - 1]) for x, end in zip(found, ends, strict=False)]


def outline_sections(titles: DataFrame, docs: DataFrame) -> DataFrame:
    """P7a, P7f: ``titles(doc_id, seq, title, level)`` located in ``docs(doc_id, content)``.

    A title counts at its first occurrence if that lies after all earlier titles';
    a section reaches to the next title; its path follows the ancestors.  A document's
    titles are gathered first (they are parts of its text), so the text is joined once,
    and all of them are found in one pass over it.
    """
    listed = titles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "title", "level"))).alias("ts"))
    rows = docs.select("doc_id", "content").join(listed, "doc_id")
    kinds = {"doc_id": rows.schema["doc_id"].dataType, "pos": IntegerType(), "title": StringType(), "level": titles.schema["level"].dataType, "content": StringType()}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                content, listed = batch.column("content")[i].as_py(), batch.column("ts")[i].as_py()
                if content is None:
                    continue
                for at in range(0, len(cuts := _cuts(content, listed)), CUTS):
                    some = cuts[at : at + CUTS]
                    ids = batch.column("doc_id").take(pa.array([i] * len(some)))
                    types = [pa.int32(), pa.string(), batch.column("ts").type.value_type.field("level").type, pa.string()]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(zip(*some, strict=True), types, strict=True))], list(kinds))

    rows = rows.mapInArrow(run, StructType([StructField(n, k) for n, k in kinds.items()]))
    along = Window.partitionBy("doc_id").orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, -1)
    ancestors = []
    deepest = titles.agg(F.max("level")).first()[0] or 0
    for level in range(1, deepest):
        # the last title of this level, unless a higher one came after it
        last = F.last(F.when(F.col("level") == level, F.struct("pos", "title")), ignorenulls=True).over(upto)
        higher = F.last(F.when(F.col("level") < level, F.col("pos")), ignorenulls=True).over(upto)
        ancestors.append(F.when((F.col("level") > level) & (F.coalesce(higher, F.lit(0)) < last["pos"]), last["title"]))
    rows = rows.withColumn("path", F.concat_ws("/", *ancestors, F.col("title")))
    rows = rows.withColumn("previous", F.lag("content").over(along)).withColumn("next", F.lead("content").over(along))
    return rows.select(hash_id(F.concat_ws("/", "doc_id", "path")).alias("id"), "doc_id", "pos", "title", "level", "path", "content", "previous", "next")


def folded_sections(found: DataFrame, least: int, most: int) -> DataFrame:
    """P7b, P7f: short sections join the following one with the same parent path up to ``most``; tiny rests go.

    A document's sections are folded in one task, in order: they are one text.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row in pdf.sort_values("pos").to_dict("records"):
            parent = row["path"].rpartition("/")[0]
            last = out[-1] if out else None
            if last and len(last["content"]) < least and last["path"].rpartition("/")[0] == parent and len(last["content"]) + len(row["content"]) <= most:
                last["content"] += row["content"]
                last["next"] = row["next"]
            else:
                out.append(row)
        return pd.DataFrame([r for r in out if 2 * len(r["content"]) >= least], columns=pdf.columns)

    return found.groupBy("doc_id").applyInPandas(fold, found.schema)
