"""Queries that SQL does not check, against plain versions of themselves."""

import pytest

from tessera.contract import queries, records
from tessera.functions import text
from tessera.model import PropertyGraph
from tessera.operators import export, sketch
from tessera.sources import diagrams, documents, star

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    return star.stored_graph(spark, DIR)


def test_chunk_packing(spark):
    docs = star.table(spark, DIR, "documents")
    rows = sorted((r.source, r.doc_id, r.tokens) for r in docs.select("source", "doc_id", text.file_tokens(records.F.length("text")).cast("long").alias("tokens")).collect())
    want, state = set(), {}
    for source, i, n in rows:
        chunk, used = state.get((source, i // 1000), (0, 0))
        if used and used + n > 6000:
            chunk, used = chunk + 1, 0
        state[source, i // 1000] = chunk, used + n
        want.add((i, chunk, n))
    assert {(r.doc_id, r.chunk, r.tokens) for r in records.packed(docs).collect()} == want


def test_digest_ignores_order(spark, graph):
    import hashlib

    got = {r.part: (r.n, r.digest) for r in queries()["canonical_digest"](spark, DIR).collect()}
    other = PropertyGraph(graph.nodes.repartition(7), graph.edges.repartition(5))
    assert got == {r.part: (r.n, r.digest) for r in export.digest(export.canonical(other)).collect()}
    lines = ["|".join((r.id, r.label, r.file_type, r.source_file)) for r in graph.nodes.collect()]
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    assert got["node"] == (len(lines), "-".join(str(sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes)) for i in range(3)))


def test_page_facts_count_links(spark):
    pages = star.table(spark, DIR, "pages")
    got = {(r.kind, r.type): r.n for r in records.page_facts(spark, DIR).collect()}
    assert sum(got.values()) > 0 and all(n > 0 for n in got.values())
    some = pages.limit(20)
    p = some.select(records.F.concat(records.F.lit("p"), "page_id", records.F.lit(".html")).alias("path"), records.F.col("html").alias("content"))
    once, twice = documents.facts(p), documents.facts(p.unionByName(p.limit(0)).repartition(3))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_label_propagation_is_stable(spark):
    first, again = (sorted(map(tuple, queries()["label_propagation"](spark, DIR).collect()), key=str) for _ in range(2))
    assert first and first == again


def test_pages_cover_the_graph(spark, graph):
    nodes = queries()["node_pages"](spark, DIR)
    assert nodes.count() == graph.nodes.count()
    communities = queries()["community_pages"](spark, DIR)
    assert communities.count() == graph.nodes.where("community is not null").select("community").distinct().count()


def test_token_benchmark_without_matches(spark, graph):
    none = sketch.token_benchmark(graph, ["zzzz qqqq"], corpus_words=75)
    assert none == {"corpus_tokens": 100, "query_tokens": 0, "reduction": 0.0}


def test_d2_arrows():
    f = documents.Facts("a.d2")
    diagrams.d2(f, "a <- b: x\nc <-> d\ne -> f -> g\nh -- i\n")
    ends = {(r[1][-1], r[4][-1]) for r in f.rows if r[0] == "edge" and r[3] == "flows_to"}
    assert ends == {("b", "a"), ("c", "d"), ("d", "c"), ("e", "f"), ("f", "g"), ("h", "i")}
