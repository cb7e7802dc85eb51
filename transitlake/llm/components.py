"""Connected components of an edge table, by contraction: roots hook onto their smallest
neighbour, chains are halved until flat, edges inside a component vanish. The rounds grow
with the logarithm of the number of vertices; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges``: ``a, b`` (long). One row per vertex: ``vertex, root``, the root being the
    smallest vertex of its component. Loops and repeated edges do no harm."""
    left = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    ends = left.select(F.col("u").alias("vertex")).union(left.select("v"))
    roots = stored(ends.distinct().withColumn("root", F.col("vertex")))
    while not left.isEmpty():
        # u > v: every root with a smaller neighbour hooks onto the smallest
        hooks = stored(left.groupBy("u").agg(F.min("v").alias("to")))
        while True:
            on = hooks.select(F.col("u").alias("_u"), F.col("to").alias("_to"))
            further = hooks.join(on, F.col("to") == F.col("_u"), "left")
            jumped = stored(further.select("u", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("_moved")))
            hooks = jumped.select("u", "to")
            if jumped.where("_moved").isEmpty():
                break
        to = hooks.select(F.col("u").alias("_u"), F.col("to").alias("_to"))
        roots = stored(roots.join(to, F.col("root") == F.col("_u"), "left").select("vertex", F.coalesce("_to", "root").alias("root")))
        other = hooks.select(F.col("u").alias("_v"), F.col("to").alias("_w"))
        ends = left.join(to, F.col("u") == F.col("_u"), "left").join(other, F.col("v") == F.col("_v"), "left")
        ends = ends.select(F.coalesce("_to", "u").alias("a"), F.coalesce("_w", "v").alias("b")).where(F.col("a") != F.col("b"))
        left = stored(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    return roots
