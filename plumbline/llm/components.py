"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, spread_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of u is linked with the smallest of u and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = spread_join(both.where("v > u"), least, "u", ("v",), rows=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the smallest of those neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return linked.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that can be reached) for all nodes of edges (u, v), longs.

    Null ends and loops are ignored; repeated edges count once. Every round ends in a checkpoint, and
    no neighbourhood is gathered anywhere: minima are aggregated and joined back. Where large-star does so,
    a node with very many neighbours is dealt to several tasks; small-star's rows are two numbers each, and a join
    that is skewed is left to adaptive execution to split.
    """
    edges = checkpointed(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        edges = checkpointed(_small_star(_large_star(edges, state[0])), state[0])
        state, before = _state(edges), state
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
