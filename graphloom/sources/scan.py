"""Scans (S1-S16): files, tables and logs to rows; sharding is Spark's partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import abbreviated, hash_id
from graphloom.session import cut


def text_table(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    """Every column a string, quoted line breaks kept; without a header columns are 0, 1, ..."""
    df = spark.read.option("multiLine", True).option("escape", '"').csv(path, header=header, sep=delimiter, inferSchema=False)
    return df if header else df.toDF(*[str(i) for i in range(len(df.columns))])


def cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each non-null cell of some columns as (id, name, content)."""
    parts = F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))
    return rows.select(parts.alias("content")).where(F.col("content").isNotNull()).select(hash_id(F.col("content")).alias("id"), abbreviated(F.col("content")).alias("name"), "content")


def positional(rows: DataFrame, names: dict[int, str]) -> DataFrame:
    """The columns at some positions under new names."""
    return rows.select(*[F.col(f"`{rows.columns[i]}`").alias(n) for i, n in sorted(names.items())])


def json_rows(spark: SparkSession, source: str, schema: str | T.StructType | None = None) -> DataFrame:
    """S3: a path, or a literal JSON array or object; a scalar is an error."""
    text = source.lstrip()
    if text[:1] in "[{":
        import json

        got = json.loads(source)
        items = got if isinstance(got, list) else [got]
        if not all(isinstance(x, dict) for x in items):
            raise ValueError("JSON rows must be objects")
        lines = spark.createDataFrame([(json.dumps(x, ensure_ascii=False),) for x in items], "value string")
        if schema is None:
            schema = lines.select(F.schema_of_json(F.lit(json.dumps({k: v for x in items for k, v in x.items()}, ensure_ascii=False)))).first()[0]
        return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    if text[:1] in '"0123456789-' or text in ("true", "false", "null"):
        raise ValueError("JSON rows must be objects")
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(source)


def titled_sentences(corpus: DataFrame, mapping: str = "corpus") -> DataFrame:
    """A map of title to sentences as documents."""
    return corpus.select(F.explode(mapping).alias("title", "sentences")).select(F.col("title").alias("id"), F.col("title").alias("name"), F.array_join("sentences", "\n").alias("content"))


def titled_texts(corpus: DataFrame, items: str = "items") -> DataFrame:
    """An array of (title, text) as documents with id ``title#place``."""
    return corpus.select(F.posexplode(items).alias("i", "x")).select(F.concat_ws("#", "x.title", F.col("i").cast("string")).alias("id"), F.col("x.title").alias("name"), F.col("x.text").alias("content"))


def files(spark: SparkSession, path: str, pattern: str | None = None, suffix: str | None = None) -> DataFrame:
    """Files below a folder whose name fits, as (path, length, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*.{suffix}")
    df = reader.load(path)
    if pattern:
        df = df.where(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    return df.select("path", "length", "content")


def partition_rows(rows: DataFrame, partition: str | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A partition filter like ``dt=20240101/hh=1``, a row limit, some columns.

    The limit counts rows read, before any unpivoting.
    """
    for part in (partition or "").replace(",", "/").split("/"):
        if part:
            key, value = part.split("=", 1)
            rows = rows.where(F.col(key.strip()).cast("string") == value.strip().strip("'"))
    if columns:
        rows = rows.select(*columns)
    return rows.limit(limit) if limit is not None else rows


def log_range(log: DataFrame, start: Column | str, end: Column | str, time: str = "ts") -> DataFrame:
    """A bounded log, both times included; the filter reaches the scan."""
    lit = lambda x: F.lit(x).cast("timestamp") if isinstance(x, str) else x
    return log.where(F.col(time).between(lit(start), lit(end)))


def triples(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """S12."""
    return split_triples(spark.read.text(path), delimiter)


def split_triples(lines: DataFrame, delimiter: str = "\t") -> DataFrame:
    """Lines of exactly three fields as (subject, relation, object)."""
    parts = lines.select(F.split("value", delimiter).alias("p")).where(F.size("p") == 3)
    return parts.select(F.col("p")[0].alias("subject"), F.col("p")[1].alias("relation"), F.col("p")[2].alias("object"))


def entity_rows(facts: DataFrame) -> DataFrame:
    """Triples regrouped per entity; a year before the value moves into the attribute.

    ``2018年-v`` of attribute a becomes attribute ``2018年a`` with value v; the
    smallest value of an attribute stays.
    """
    year = F.regexp_extract("object", "^(\\d{4}年)-", 1)
    rows = facts.select("subject", F.concat(year, "relation").alias("k"), F.when(year != "", F.regexp_replace("object", "^\\d{4}年-", "")).otherwise(F.col("object")).alias("v"))
    one = rows.groupBy("subject", "k").agg(F.min("v").alias("v"))
    return one.groupBy(F.col("subject").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))


def shard(rows: DataFrame, order: str, index: int, count: int) -> DataFrame:
    """One of ``count`` contiguous ranges of ceil(n / count) rows; no row is lost or doubled.

    For parity only: plain scans leave this to Spark's partitions.
    """
    total = rows.count()
    width = max(1, -(-total // count))
    # rows are range-sorted; a partition's first number comes from the partitions before it
    placed = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).select("*", F.monotonically_increasing_id().alias("_m"))
    placed = cut(placed.select("*", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_i")))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    return placed.join(F.broadcast(before), "_p").where(F.floor((F.col("_before") + F.col("_i")) / width) == index).drop("_m", "_p", "_i", "_before")
