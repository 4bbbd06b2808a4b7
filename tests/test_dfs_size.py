"""Depth-first visits against a plain stack: hubs by their degree in the whole graph, any number of edges."""

import random

import pytest

from tessera.model import PropertyGraph, stored
from tessera.operators import traverse

NODES = "id string, label string, file_type string, source_file string, community long, node_ord long"
EDGES = "src string, tgt string, relation string, confidence string, source_file string, context string"


def graph(spark, ids, pairs):
    nodes = spark.createDataFrame([(i, i, "code", "f.py", None, n) for n, i in enumerate(ids)], NODES)
    return PropertyGraph(nodes, spark.createDataFrame([(a, b, "calls", "EXTRACTED", "f.py", None) for a, b in pairs], EDGES))


def plain(ids, pairs, seed, depth):
    near, degree = {i: set() for i in ids}, dict.fromkeys(ids, 0)
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            if a != b:
                near[x].add(y)
                degree[x] += 1
    floor = max(50, sorted(degree.values())[len(ids) * 99 // 100])
    stack, order = [(seed, 0)], []
    while stack:
        node, at = stack.pop()
        if node in order or at > depth:
            continue
        order.append(node)
        if node == seed or degree[node] < floor:
            stack.extend((x, at + 1) for x in sorted(near[node], reverse=True))
    return order


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_equals_plain_stack(spark, depth):
    rng = random.Random(depth)
    ids = [f"n{i}" for i in range(300)] + ["hub"]
    pairs = [(rng.choice(ids[:300]), rng.choice(ids[:300])) for _ in range(500)] + [("hub", i) for i in rng.sample(ids[:300], 200)]
    g = graph(spark, ids, pairs)
    for seed in ("n7", "hub"):
        got = [(r.place, r.id) for r in traverse.dfs(g, seed, depth).orderBy("place").collect()]
        assert got == list(enumerate(plain(ids, pairs, seed, depth)))
    assert traverse.dfs(g, "unknown", depth).count() == 0


def test_hub_with_few_neighbours_in_the_ball(spark):
    """A hub isn't passed, although few of its neighbours are near the seed: x is reached from a, and y from x."""
    ids = ["a", "h", "x", "y", *(f"l{i}" for i in range(60))]
    pairs = [("a", "h"), ("a", "x"), ("h", "x"), ("x", "y"), *(("h", f"l{i}") for i in range(60))]
    got = traverse.dfs(graph(spark, ids, pairs), "a", 2).orderBy("place").collect()
    assert [r.id for r in got] == ["a", "h", "x", "y"]


def test_more_than_a_million_edges(spark, tmp_path):
    from pyspark.sql import functions as F

    n, m = 2000, 520
    side = spark.range(n).select(F.concat(F.lit("a"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"))
    nodes = side.union(spark.createDataFrame([("s",)], "id string"))
    nodes = nodes.select("id", F.col("id").alias("label"), F.lit("code").alias("file_type"), F.lit("f.py").alias("source_file"), F.lit(None).cast("long").alias("community"), F.lit(0).cast("long").alias("node_ord"))
    other = spark.range(1, m + 1).withColumnRenamed("id", "step")
    ring = spark.range(n).crossJoin(other).select(F.col("id").alias("i"), ((F.col("id") + F.col("step")) % n).alias("j"))
    name = lambda c: F.concat(F.lit("a"), F.lpad(F.col(c).cast("string"), 4, "0"))
    e = ring.select(name("i").alias("src"), name("j").alias("tgt")).union(side.select(F.lit("s"), "id"))
    e = e.select("src", "tgt", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit("f.py").alias("source_file"), F.lit(None).cast("string").alias("context"))
    got = [r.id for r in traverse.dfs(stored(PropertyGraph(nodes, e), str(tmp_path)), "s", 2).orderBy("place").collect()]
    assert got == ["s", *(f"a{i:04}" for i in range(n))]
