"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from metaeval.llm import flat


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(key).agg(F.min(other).alias("least"))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node it is linked with over any number of links.

    Large and small stars in turn: every node hands its larger neighbours, then
    its smaller ones, to the least node it knows. Neighbours are never collected;
    only their minimum is taken, which combines before the shuffle. Nodes without
    a link to another node are not in the result. Null nodes are left out.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u > v").distinct()
    edges = flat.written(edges)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, "u", "v").select("u", F.least("u", "least").alias("least"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u > v").distinct()
        small = large.join(_least(large, "u", "v"), "u")
        edges = small.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
        edges = flat.written(edges.select("e.u", "e.v").filter("u > v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
