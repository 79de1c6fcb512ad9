"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import remove, staged


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it can reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round is
    a map-side combined minimum and an equi-join, so a node with very many neighbours
    is split by the adaptive skew join and never gathered in one task. The edge list
    is written to the shared folder after each round. Ends when a round changes
    nothing. Self loops are ignored; an empty list gives an empty result.
    Returns (node, root) for the nodes that have an edge.
    """

    def canonical(frame):
        big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        return frame.select(big, small).where("u <> v").distinct()

    def mark(frame):
        row = frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    current = staged(canonical(edges), "edges")
    before = mark(current)
    for _ in range(max_rounds if before[0] else 0):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = canonical(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        following = staged(canonical(small), "edges")
        after = mark(following)
        remove(current)
        current = following
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
