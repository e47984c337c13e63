"""Connected components by alternating star contractions, on DataFrames.

Each round joins edges with each node's smallest neighbour, which is unique on its side, so
a node with very many edges is split by Spark like any skewed join key.  The number of
rounds grows with the logarithm of the longest path.  Rounds are staged in the shared
folder; nothing of the graph reaches the driver but a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.plans.staging import drop, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has an edge; label is the smallest node reached."""
    u, v = F.col(a), F.col(b)
    now = stage(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state.n, state.x) == seen or not state.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        seen = (state.n, state.x)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y"))))
        small = large.join(least, "u").select(ends.alias("e")).select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).filter("u <> v").distinct()
        small = stage(small, "small_star")
        drop(now)
        drop(large)
        now = small
