"""Stage memo (2.19): a stage is computed once for each distinct input and setting.

A stage's table holds its outputs under the hash of the input row; the stage's folder is
named by a hash of its name and settings.  A run hashes its inputs, takes those without
an entry by an anti join, computes them, appends their outputs and then their keys, and
answers from the table.  Keys are written last, so a run that fails is repeated from
what the manifest knows; two inputs of equal content are computed once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions.text import canonical_map
from graphloom.sources.manifest import Manifest

#: Name of the input's hash in a stage's rows.
KEY = "input_key"


def row_key(rows: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the JSON of some columns; maps are written in order of their keys."""
    kinds = dict(rows.dtypes)
    parts = [canonical_map(F.col(c)) if kinds[c].startswith("map<") else F.col(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


class Memo:
    """Remembered stages under ``path``, which all sessions of a pipeline share."""

    def __init__(self, spark: SparkSession, path: str, most: int = 16):
        """``most`` segments of a stage are merged when there are more."""
        self.spark, self.path, self.most = spark, path, most
        self.computed: dict[str, int] = {}

    def run(self, stage: str, rows: DataFrame, build: Callable[[DataFrame], DataFrame], settings: dict | None = None, on: list[str] | None = None) -> DataFrame:
        """``build``'s rows for the distinct contents of ``rows``, each under its ``input_key``.

        ``build`` gets new rows with ``input_key`` and must carry it on; it may give any
        number of rows for an input.  ``on`` are the columns that make the content.
        """
        name = hashlib.sha256(json.dumps([stage, settings or {}], sort_keys=True).encode()).hexdigest()
        manifest = Manifest(self.spark, f"{self.path}/{name}")
        version = manifest.version()
        state = manifest.read(version) or {"segments": [], "schema": None}
        keyed = rows.withColumn(KEY, row_key(rows, on or rows.columns)).dropDuplicates([KEY])
        known = self._table(f"{self.path}/{name}", state, "keys", StructType.fromDDL(f"{KEY} string"))
        new = keyed if known is None else keyed.join(known, KEY, "left_anti")
        segment = uuid.uuid4().hex
        root = f"{self.path}/{name}"
        new.write.parquet(f"{root}/new-{segment}")
        new = self.spark.read.schema(new.schema).parquet(f"{root}/new-{segment}")
        self.computed[stage] = new.count()
        if self.computed[stage] or state["schema"] is None:
            made = build(new)
            made.write.parquet(f"{root}/rows-{segment}")
            new.select(KEY).write.parquet(f"{root}/keys-{segment}")
            state = {"segments": [*state["segments"], segment], "schema": made.schema.json()}
            if len(state["segments"]) > self.most:
                state = self._merged(root, state)
            manifest.write(state, version)
        done = self._table(root, state, "rows", StructType.fromJson(json.loads(state["schema"])))
        return done.join(keyed.select(KEY), KEY, "left_semi")

    def _table(self, root: str, state: dict, what: str, schema: StructType) -> DataFrame | None:
        parts = [self.spark.read.schema(schema).parquet(f"{root}/{what}-{s}") for s in state["segments"]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _merged(self, root: str, state: dict) -> dict:
        segment = uuid.uuid4().hex
        self._table(root, state, "rows", StructType.fromJson(json.loads(state["schema"]))).hint("rebalance").write.parquet(f"{root}/rows-{segment}")
        self._table(root, state, "keys", StructType.fromDDL(f"{KEY} string")).hint("rebalance").write.parquet(f"{root}/keys-{segment}")
        return {**state, "segments": [segment]}
