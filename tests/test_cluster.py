"""Leiden communities on planted graphs, against plain modularity and connectedness."""

import random

from tessera.model import PropertyGraph
from tessera.operators import cluster as C

NODES = "id string, label string, file_type string, source_file string, community long, node_ord long"
EDGES = "src string, tgt string, relation string, confidence string, source_file string, context string"


def graph(spark, ids, pairs):
    nodes = spark.createDataFrame([(i, i, "code", "f.py", None, n) for n, i in enumerate(ids)], NODES)
    return PropertyGraph(nodes, spark.createDataFrame([(a, b, "calls", "EXTRACTED", "f.py", None) for a, b in pairs], EDGES))


def plain_modularity(of, pairs):
    pairs = [(a, b) for a, b in pairs if a != b and a in of and b in of]
    m = len(pairs)
    degree = {}
    for a, b in pairs:
        degree[of[a]] = degree.get(of[a], 0) + 1
        degree[of[b]] = degree.get(of[b], 0) + 1
    return sum(of[a] == of[b] for a, b in pairs) / m - sum(d * d for d in degree.values()) / (4 * m * m)


def connected(of, pairs):
    """Whether each community is one component of the edges inside it."""
    root = {i: i for i in of}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a in of and b in of and of[a] == of[b]:
            root[find(a)] = find(b)
    return len({find(i) for i in of}) == len(set(of.values()))


def test_planted_groups(spark):
    r = random.Random(5)
    ids = [f"n{i:02}" for i in range(40)]
    pairs = [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids[:i]) if r.random() < (0.7 if i // 10 == j // 10 else 0.03)]
    g = graph(spark, [*ids, "alone"], [*pairs, ("n00", "n00"), ("n00", "nowhere"), ("alone", None)])
    found = C.leiden(g.nodes.selectExpr("id", "'' AS part"), g.edges)
    of = {x.id: x.community for x in found.collect()}
    assert set(of) == {*ids, "alone"} and of["alone"] == "alone"
    assert len(set(of.values())) == 5 and all(len({of[i] for i in ids[k : k + 10]}) == 1 for k in range(0, 40, 10))
    assert all(of[i] == min(j for j in of if of[j] == of[i]) for i in of)
    del of["alone"]
    assert connected(of, pairs)
    planted = {i: str(n // 10) for n, i in enumerate(ids)}
    got = C.modularity(spark.createDataFrame(list(of.items()), "id string, community string"), g.edges)
    assert abs(got - plain_modularity(of, pairs)) < 1e-12 and got >= plain_modularity(planted, pairs) - 1e-12


def test_reruns_parts_and_numbers(spark):
    ring = [(f"k{i}{a}", f"k{i}{b}") for i in range(6) for a in range(5) for b in range(a)] + [(f"k{i}0", f"k{(i + 1) % 6}1") for i in range(6)]
    ids = sorted({x for p in ring for x in p})
    g = graph(spark, ids, ring)
    one = {x.id: x.community for x in C.cluster(g).collect()}
    two = {x.id: x.community for x in C.cluster(PropertyGraph(g.nodes.repartition(7), g.edges.repartition(3))).collect()}
    assert one == two and connected(one, ring)
    assert sorted(set(one.values())) == list(range(6)) and all(len({one[f"k{i}{a}"] for a in range(5)}) == 1 for i in range(6))
    parts = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, part string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, tgt string")
    assert {x.id: x.community for x in C.leiden(parts, edges).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_no_edges(spark):
    g = graph(spark, ["a", "b"], [])
    assert {x.id: x.community for x in C.cluster(g).collect()} == {"a": 0, "b": 1}
    assert C.cluster(graph(spark, [], [])).count() == 0
