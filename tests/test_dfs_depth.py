"""The registered depth-first visit goes as deep as its name says."""

import __spark_entry__


def test_second_level(spark):
    known, sf_dir = __spark_entry__.queries(), "/root/testdata/sf0.001"
    hops = {r.id: r.hop for r in known["bfs_depth2"](spark, sf_dir).collect()}
    visit = [r.id for r in known["dfs_depth2"](spark, sf_dir).orderBy("place").collect()]
    print("visited", len(visit), "of them two hops away", sum(hops[i] == 2 for i in visit))
    assert len(set(visit)) == len(visit) and set(visit) <= set(hops)
    assert {hops[i] for i in visit} == {0, 1, 2}
