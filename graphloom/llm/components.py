"""Connected components by minimum labels with pointer jumping, all as joins.

Each round is written in the shared folder and the one before deleted, so lineage
stays short and a lost executor costs at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every end of ``edges(a, b)``; component is the smallest vertex reachable."""
    spark = edges.sparkSession
    proper = edges.where("a <> b").select("a", "b")
    both, both_path = stored(proper.unionByName(proper.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    first = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b"))
    moved, path = stored(first.select("v", F.lit(None).cast("long").alias("old"), F.least("v", "b").alias("component")), "labels")
    while moved.where("old IS NULL OR old <> component").limit(1).count():
        labels = moved.select("v", "component")
        near = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("u")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels.v == near.u).select("v", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("v").alias("w"), F.col("component").alias("further"))
        moved, new = stored(stepped.join(jump, stepped.mid == jump.w, "left").select("v", "old", F.least("mid", F.coalesce("further", "mid")).alias("component")), "labels")
        discard(spark, path)
        path = new
    discard(spark, both_path)
    return moved.select("v", "component")
