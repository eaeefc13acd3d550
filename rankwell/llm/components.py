"""Connected components of a table of edges, by repeated joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge and the smallest node it is connected to.

    Each round links the larger ends of a node's edges to its smallest neighbour, then the other way
    round, until only stars are left; the number of edges never grows.
    """
    pair = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    pair = cut_lineage(pair)
    while True:
        # Larger neighbours go to the smallest neighbour, the node itself included.
        both = pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        large = cut_lineage(large.distinct())
        # Smaller neighbours and the node itself go to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
        small = small.unionByName(least.select(F.col("m").alias("a"), "b"))
        after = cut_lineage(small.distinct())
        changed = after.exceptAll(pair).limit(1).count()
        pair = after
        if not changed:
            break
    roots = pair.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return roots.unionByName(pair.select(F.col("b").alias("node"), F.col("a").alias("root")))
