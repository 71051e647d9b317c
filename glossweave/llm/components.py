"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any orderable type to (node, root), the root being the least node of the component.

    Nodes without an edge to another node don't appear. Null ends, loops and repeated edges have no effect. Each
    round leaves its edges as a table in the shared folder; the rounds grow with the logarithm of the diameter.
    """
    edges = edges.select("u", "v").where("u <> v").distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = _with_least(down)
        small = starred.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(starred.select("u", F.col("least").alias("v")))
        edges = stored(small.where("u <> v").distinct())
        # a forest of stars: every node has one edge, and no root has one of its own
        loose = edges.groupBy("u").count().where("count > 1").limit(1).count()
        if not loose and not edges.join(edges.select(F.col("u").alias("root")), F.col("v") == F.col("root"), "left_semi").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
