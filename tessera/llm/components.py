"""Connected components by alternating large-star and small-star rounds, as DataFrame joins.

Each round keeps at most as many edges as the last one.  Rounds grow as the logarithm of the
longest path.  Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, split_join


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour."""
    mins = _mins(edges).withColumnRenamed("u", "v")
    return split_join(edges, mins, ["v"], "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, go to the smallest of them."""
    joined = split_join(edges, _mins(edges), ["u"], "inner")
    moved = joined.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(_mins(edges).select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that can be reached.

    edges: two columns of longs; loops and repeated edges are allowed.  An empty table gives an
    empty table.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.save(now, "edges0")

    def mark(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s")).first()
        return r["n"], r["x"], r["s"]

    before = mark(now)
    for i in range(1, max_rounds + 1):
        if before[0] == 0:
            break
        new = scratch.save(_small_star(_large_star(now).distinct()), f"edges{i}")
        after = mark(new)
        scratch.drop(f"edges{i - 1}")
        now = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
