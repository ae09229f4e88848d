"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges; two sums, so equal states mean equal edges for all practical purposes."""
    code = F.xxhash64("high", "low")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(code, F.lit(1 << 31))), F.sum(F.shiftright(code, 33))).collect()[0])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of ``links``: the smallest node it reaches.

    Both steps need the minimum over a node's neighbours, which is pre-aggregated before the shuffle, and a join that sends it to them,
    which Spark splits where a node has very many.  Edges are written to the shared folder after every round and never collected.
    """
    edges = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct()
    edges = stored(edges, "components")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("least")).select("high", F.least("high", "least").alias("least"))
        large = both.where("low > high").join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        moved = large.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        edges = stored(moved.unionByName(least.select("high", F.col("least").alias("low"))).where("high <> low").distinct(), "components")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
