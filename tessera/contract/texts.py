"""Rendered texts, sketches and checks around clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.contract.measures import on_graph
from tessera.contract.star_sql import graph
from tessera.contract.traverse import QUESTION, SEED
from tessera.model import PropertyGraph, cut
from tessera.operators import cluster as L
from tessera.operators import render as R
from tessera.operators import sketch as K
from tessera.sources.star import table


def ball(g):
    from tessera.operators.traverse import bfs

    return cut(bfs(g, g.nodes.where(F.col("id") == SEED).select("id"), 1))


def coarse(g):
    """Communities by kind: some are too large, some are thin."""
    kind = F.when(F.startswith("id", F.lit("customer")), 0).when(F.startswith("id", F.lit("part")), 1).otherwise(F.col("community") + 10)
    return PropertyGraph(g.nodes.withColumn("community", kind.cast("long")), g.edges)


COARSE = "coarse AS (SELECT id, CASE WHEN id LIKE 'customer%' THEN 0 WHEN id LIKE 'part%' THEN 1 ELSE community + 10 END AS community FROM nodes)"


def benchmark(g):
    found = K.token_benchmark(g, [QUESTION, "brand new parts"], ascii_labels=True)
    return g.nodes.sparkSession.createDataFrame([(found["corpus_tokens"], float(found["query_tokens"]), float(found["reduction"]))], "corpus_tokens long, query_tokens double, reduction double")


QUERIES = {
    "subgraph_text": on_graph(lambda g: R.subgraph_lines(g, ball(g))),
    "tree_text": on_graph(R.tree_lines),
    "node_pages": on_graph(R.node_pages),
    "community_pages": on_graph(R.community_pages),
    "minhash_similarity": lambda spark, d: K.sketch_pairs(cut(table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text").unionByName(table(spark, d, "conversations").select(F.concat_ws("/", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"))), 0.7),
    "token_benchmark": on_graph(benchmark),
    "leiden_communities": on_graph(L.cluster),
    "community_split_marks": on_graph(lambda g: K.split_marks(coarse(g))),
    "community_singletons": on_graph(lambda g: K.singletons(coarse(g))),
    "clean_labels": on_graph(lambda g: g.nodes.select("id", R.plain(F.concat("label", F.lit("\x01\x7f!"))).alias("label"))),
}

_INNER = "(SELECT DISTINCT least(src, tgt) AS x, greatest(src, tgt) AS y, a.community AS c FROM edges JOIN coarse a ON src = a.id JOIN coarse b ON tgt = b.id WHERE src <> tgt AND a.community = b.community)"

ORACLES = {
    "tree_text": graph(
        """SELECT label AS path, '- ' || label AS line FROM nodes WHERE id LIKE 'region:%' AND id IN (SELECT src FROM edges WHERE relation = 'contains')
           UNION ALL SELECT a.label || ' / ' || b.label, '  - ' || b.label FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.tgt = b.id WHERE relation = 'contains' AND e.src LIKE 'region:%'
           UNION ALL SELECT a.label || ' / ' || b.label || ' / ' || c.label, '    - ' || c.label FROM edges e JOIN edges f ON e.tgt = f.src JOIN nodes a ON e.src = a.id JOIN nodes b ON e.tgt = b.id JOIN nodes c ON f.tgt = c.id WHERE e.relation = 'contains' AND f.relation = 'contains' AND e.src LIKE 'region:%'"""
    ),
    "community_split_marks": graph(
        f"""SELECT community, size, reason FROM (SELECT s.community, s.size, CASE WHEN s.size > greatest(10, (SELECT count(*) FROM nodes) // 4) THEN 'oversized' WHEN s.size >= 50 AND coalesce(p.n, 0) / (s.size * (s.size - 1) / 2.0) < 0.05 THEN 'sparse' END AS reason
           FROM (SELECT CAST(community AS BIGINT) AS community, count(*) AS size FROM coarse WHERE community IS NOT NULL GROUP BY 1) s LEFT JOIN (SELECT c, count(*) AS n FROM {_INNER} i GROUP BY c) p ON p.c = s.community) q WHERE reason IS NOT NULL""",
        COARSE,
    ),
    "community_singletons": graph(f"SELECT id FROM coarse WHERE community IS NOT NULL AND id NOT IN (SELECT x FROM {_INNER} i UNION SELECT y FROM {_INNER} j)", COARSE),
    "clean_labels": graph("SELECT id, label || '!' AS label FROM nodes"),
}
