"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrep.session import cut_lineage


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` of every node that is linked to a smaller one; ``root`` is the smallest it can reach.

    A large step links the larger neighbours of each node to its smallest
    neighbour, a small step the smaller ones. Both keep the components and end
    in one star each. The minimum of a node is summed on the map side and then
    joined, so a node with very many links is split by the join, not gathered.
    Each round is written to the shared folder.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    links = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct()
    links = cut_lineage(links, "links")
    before = _state(links)
    while before[0]:
        both = links.select(F.col("high").alias("u"), F.col("low").alias("v")).union(links.select("low", "high"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        large = cut_lineage(large, "large-star")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").select(F.explode(F.array(F.struct("high", F.col("m").alias("low")), F.struct(F.col("low").alias("high"), F.col("m").alias("low")))).alias("x"))
        links = cut_lineage(small.select("x.*").where("high <> low").distinct(), "small-star")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
