"""Leiden in one task and in rounds of joins: planted groups, connected communities, and few jobs."""

import random

import numpy as np
import pytest

from tessera.operators import cluster as C
from tessera.operators import leiden as L

from test_cluster import connected, graph, plain_modularity


def planted(r, groups=8, size=12, within=0.6, across=0.02):
    ids = [f"n{i:03}" for i in range(groups * size)]
    return ids, [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids[:i]) if r.random() < (within if i // size == j // size else across)]


@pytest.mark.parametrize("arcs", [0, 100, C.ARCS])
def test_planted(spark, monkeypatch, arcs):
    """Rounds of joins only, rounds first and one task then, one task only."""
    monkeypatch.setattr(C, "ARCS", arcs)
    ids, pairs = planted(random.Random(8), 4, 10, 0.8, 0.03)
    g = graph(spark, ids, pairs)
    of = {x.id: x.community for x in C.leiden(g.nodes.selectExpr("id", "'' AS part"), g.edges).collect()}
    assert len(of) == 40 and connected(of, pairs)
    assert all(len({of[i] for i in ids[k : k + 10]}) == 1 for k in range(0, 40, 10)) and len(set(of.values())) == 4
    assert all(of[i] == min(j for j in of if of[j] == of[i]) for i in of)


def arrays(n, pairs):
    arcs = sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})
    a, b = np.array(arcs).T
    return np.searchsorted(a, np.arange(n + 1)), b, np.ones(len(b))


@pytest.mark.parametrize("seed", range(20))
def test_no_single_move_or_merge_gains(seed):
    r = random.Random(seed)
    ids, pairs = planted(r, r.randrange(2, 9), r.randrange(3, 15), r.random(), 0.1 * r.random())
    place = {x: i for i, x in enumerate(ids)}
    pairs = [(place[a], place[b]) for a, b in pairs] or [(0, 1)]
    n = len(ids)
    begin, other, weight = arrays(n, pairs)
    k = np.diff(begin).astype(float)
    used = np.flatnonzero(k)
    m2 = np.full(n, k.sum())
    of = dict(enumerate(L.communities(begin, other, weight, k, m2, np.arange(n), 1.0, 12).tolist()))
    assert connected(of, pairs)
    of = {v: of[v] for v in used.tolist()}
    now = plain_modularity(of, pairs)
    assert now >= plain_modularity({v: 0 for v in of}, pairs) - 1e-9 and now >= plain_modularity({v: v for v in of}, pairs)
    for c in set(of.values()):
        for d in set(of.values()) - {c}:
            assert plain_modularity({v: c if x == d else x for v, x in of.items()}, pairs) <= now + 1e-9


def test_star_graph_takes_few_jobs(spark):
    """One task in place of rounds of joins, each of which is several jobs."""
    import __spark_entry__

    track = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("leiden", "leiden")
    try:
        found = __spark_entry__.queries()["leiden_communities"](spark, "/root/testdata/sf0.001")
        rows = found.count()
        jobs = len(track.getJobIdsForGroup("leiden"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    print("jobs", jobs)
    assert rows and 0 < jobs < 150


def test_runs_until_little_is_gained():
    """One run alone leaves more than GAIN to the next one on such graphs."""
    gained = []
    for seed in range(6):
        r = random.Random(seed)
        pairs = list({(min(p), max(p)) for p in ((r.randrange(400), r.randrange(400)) for _ in range(1600)) if p[0] != p[1]})
        begin, other, weight = arrays(400, pairs)
        k = np.diff(begin).astype(float)
        graph_ = begin, other, weight, k, np.full(400, k.sum())
        once = L._once(*graph_, np.arange(400), 1.0, 12)
        found = L.communities(*graph_, np.arange(400), 1.0, 12)
        assert connected(dict(enumerate(found.tolist())), pairs)
        now = plain_modularity(dict(enumerate(found.tolist())), pairs)
        assert abs(L.quality(*graph_, found, 1.0) - now) < 1e-9
        gained.append(now - plain_modularity(dict(enumerate(once.tolist())), pairs))
    assert min(gained) >= 0 and max(gained) > L.GAIN
