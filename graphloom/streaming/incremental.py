"""Unbounded input (S10, 2.19): replayed logs, keyed de-duplication, native windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.graph import Graph
from graphloom.operators.store import GraphStore
from graphloom.session import shared_dir
from graphloom.sources.manifest import Manifest


def log_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, pattern: str | None = None) -> DataFrame:
    """Files as an unbounded log; offsets live in the query's checkpoint."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def distinct_events(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """One row a key within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, keys: list[str], width: str = "1 hour", slide: str | None = None, time: str = "ts", late: str = "1 day") -> DataFrame:
    """An extra beyond parity: event counts and sums by tumbling or sliding window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide or width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", time: str = "ts", late: str = "1 day") -> DataFrame:
    """An extra beyond parity: session windows."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and reads the written result; the folder is shared."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def first_rows(stream: DataFrame, key: str, time: str | None = None, late: str | None = None) -> DataFrame:
    """The first row of each key; the keys are state of the stream, held by partition of the key and looked up, never reread.

    With ``time`` and ``late`` a key is forgotten when the watermark has passed it by
    ``late``, so state is bounded by what arrives in that time; rows later than that go.
    """
    if time is not None:
        return stream.withWatermark(time, late or "1 day").dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def build_incrementally(stream: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], out: str, state: str, time: str | None = None, late: str | None = None) -> None:
    """Runs ``build`` on rows whose key no earlier row has had, in any earlier run of the same ``state`` folder.

    Keys are the stream's state (``first_rows``), kept on disk with its checkpoint; the rows
    of a batch are written under its number, so a batch that is repeated after a failure
    overwrites itself and nothing is lost or doubled.
    """
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:

        def step(batch: DataFrame, number: int) -> None:
            build(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

        rows = first_rows(stream, key, time, late)
        rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


def add_to_graph(store: GraphStore, to_graph: Callable[[DataFrame], Graph], root: str) -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch`` that upserts each batch's graph; ``root`` remembers the batches that are done.

    An upsert of the same batch changes nothing, so a batch that fails between the two is repeated safely.
    """

    def step(batch: DataFrame, number: int) -> None:
        done = Manifest(batch.sparkSession, root)
        version = done.version()
        if done.read(version).get("batch", -1) < number:
            store.upsert(to_graph(batch))
            done.write({"batch": number}, version)

    return step
