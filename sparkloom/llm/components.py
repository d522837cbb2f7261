"""Connected components of an edge table, as alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored


def _pointed(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, with the least neighbour of its first end (or itself)."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-both")
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least")
    return both.join(least.hint("shuffle_merge"), "a")


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node of edges(a, b).

    Edges are undirected longs; loops and repeats are ignored and nulls dropped.  Each round
    writes its edges to the scratch folder, so no lineage grows and a lost executor costs one
    round at most.  Hot nodes are met by aggregation and by joins that Spark can split.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(ends.distinct(), "cc-edges")
    before = None
    for _ in range(rounds):
        here = _checksum(now)
        if here == before or not here[0]:
            break
        before = here
        # Large star: every larger neighbour of a node moves to the node's least neighbour.
        large = _pointed(now).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), "cc-large")
        # Small star: a node and its smaller neighbours move to the least of them.
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "cc-small")
        small = large.join(least.hint("shuffle_merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    member = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return member.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
