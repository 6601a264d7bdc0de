"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import drop_staged, stage


def _star(pairs: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v) with the least neighbour m of each u. The least neighbours are written first, so that
    both join sides come straight from an exchange and a hub's rows can be split among tasks."""
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("m")), label)
    return pairs.join(least, "u"), least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """One row (node, root) for each node that some edge joins to another; root is the component's least node.

    Edges are two long columns, in any direction, repeats allowed; self-loops and nulls join nothing. An empty
    edge table gives an empty result. Work per round is linear in the edges, rounds grow with the logarithm of
    the longest chain; raises if max_rounds don't suffice (never returns a partial answer).
    """
    e = stage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, m1 = _star(both, "large-min")
        large = stage(joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        joined, m2 = _star(large, "small-min")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m2.select("u", F.col("m").alias("v")))
        new = stage(small.distinct(), "edges")
        drop_staged(e, m1, large, m2)
        e = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
