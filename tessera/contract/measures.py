"""Graph, degrees, communities and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import model
from tessera.contract.star_sql import graph
from tessera.operators import measures as M
from tessera.sources.star import star_graph, stored_graph


def on_tables(f):
    """A query over the graph as it follows from the tables."""
    return lambda spark, sf_dir: f(star_graph(spark, sf_dir))


def on_graph(f):
    """A query over the stored graph."""
    return lambda spark, sf_dir: f(stored_graph(spark, sf_dir))


def marked_edges(g):
    """Edges as a file stores them: calls reversed and marked, uses with markers that name other nodes."""
    e = g.edges.withColumn("back", F.col("relation") == "calls")
    stale = F.col("relation") == "uses"
    mark = lambda c: F.when(F.col("back"), F.col(c)).when(stale, F.lit("gone"))
    return e.select(F.when(F.col("back"), F.col("tgt")).otherwise(F.col("src")).alias("source"), F.when(F.col("back"), F.col("src")).otherwise(F.col("tgt")).alias("target"), "relation", mark("src").alias("ms"), mark("tgt").alias("mt"))


def edge_true_direction(g):
    s, t = model.true_direction(F.col("source"), F.col("target"), F.col("ms"), F.col("mt"))
    return marked_edges(g).select("source", "target", "relation", s.alias("src"), t.alias("tgt"))


def dirty(g):
    """Edges with repeats, loops, missing ends and odd weights."""
    keep = ["src", "tgt", "relation", "source_file", "context"]
    e = g.edges.select(*keep)
    twice = e.where(F.endswith("tgt", F.lit("7")))
    loops = e.where(F.endswith("src", F.lit("3"))).withColumn("tgt", F.col("src"))
    lost = e.where(F.endswith("tgt", F.lit("11"))).withColumn("tgt", F.concat("tgt", F.lit("x")))
    other = e.where(F.endswith("tgt", F.lit("5"))).withColumns({"relation": F.lit("references"), "source_file": F.lit("other.py"), "context": F.lit("attribute")})
    return e.unionByName(twice).unionByName(loops).unionByName(lost).unionByName(other)


DIRTY = """
dirty AS (
  SELECT src, tgt, relation, source_file, context FROM edges
  UNION ALL SELECT src, tgt, relation, source_file, context FROM edges WHERE tgt LIKE '%7'
  UNION ALL SELECT src, src, relation, source_file, context FROM edges WHERE src LIKE '%3'
  UNION ALL SELECT src, tgt || 'x', relation, source_file, context FROM edges WHERE tgt LIKE '%11'
  UNION ALL SELECT src, tgt, 'references', 'other.py', 'attribute' FROM edges WHERE tgt LIKE '%5'
)"""

QUERIES = {
    "graph_nodes": on_tables(lambda g: g.nodes),
    "graph_edges": on_tables(lambda g: g.edges),
    "edge_true_direction": on_graph(edge_true_direction),
    "degrees": on_graph(M.degrees),
    "degrees_distinct_pairs": on_graph(M.pair_degrees),
    "hub_threshold": on_graph(M.hub_threshold),
    "god_nodes_analysis": on_graph(M.god_nodes),
    "god_nodes_query": on_graph(M.god_nodes_query),
    "confidence_distribution": on_graph(M.confidences),
    "graph_stats": on_graph(M.stats),
    "community_members": on_graph(M.members),
    "community_cohesion": on_graph(M.cohesion),
    "community_hub_label": on_graph(M.hub_labels),
    "multigraph_diagnostics": on_graph(lambda g: M.diagnostics(dirty(g), g.nodes)),
    "isolated_nodes": on_graph(M.isolated),
    "community_reindex": on_graph(lambda g: M.community_sizes(g.nodes.where("community is not null").select("id", "community"))),
    "default_scores": on_graph(lambda g: g.edges.groupBy("relation", "confidence").agg(F.count("*").alias("n"), F.round(F.sum(model.default_score(F.col("confidence"))), 6).alias("score"))),
}

_CALLABLE = "label LIKE '%()'"
_FILE = "(label <> '' AND ((source_file <> '' AND (label = regexp_extract(source_file, '[^/]*$') OR (contains(label, '/') AND (source_file = label OR ends_with(source_file, '/' || label))))) OR (label LIKE '.%' AND label LIKE '%()') OR (label LIKE '%()' AND degree <= 1)))"
_CONCEPT = "(source_file = '' OR NOT contains(regexp_extract(source_file, '[^/]*$'), '.'))"
_PAIRS = "pairs AS (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM known), pd AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) q GROUP BY id)"
_noise = lambda names: ", ".join(f"'{n}'" for n in names)

ORACLES = {
    "graph_nodes": graph("SELECT * FROM nodes"),
    "graph_edges": graph("SELECT * FROM edges"),
    "edge_true_direction": graph(
        """SELECT source, target, relation,
             CASE WHEN (ms = source AND mt = target) OR (ms = target AND mt = source) THEN ms ELSE source END AS src,
             CASE WHEN (ms = source AND mt = target) OR (ms = target AND mt = source) THEN mt ELSE target END AS tgt
           FROM (SELECT CASE WHEN relation = 'calls' THEN tgt ELSE src END AS source, CASE WHEN relation = 'calls' THEN src ELSE tgt END AS target, relation,
                        CASE relation WHEN 'calls' THEN src WHEN 'uses' THEN 'gone' END AS ms, CASE relation WHEN 'calls' THEN tgt WHEN 'uses' THEN 'gone' END AS mt FROM edges) q"""
    ),
    "degrees": graph("SELECT id, degree FROM degrees", degrees=True),
    "degrees_distinct_pairs": graph("SELECT id, degree FROM pd", _PAIRS, degrees=True),
    "hub_threshold": graph(
        "SELECT greatest(degree, 50) AS threshold FROM (SELECT degree, row_number() OVER (ORDER BY degree) AS r, count(*) OVER () AS n FROM degrees) q WHERE r = n * 99 // 100 + 1", degrees=True
    ),
    "god_nodes_analysis": graph(
        f"SELECT id, CASE WHEN label = '' THEN id ELSE label END AS label, degree FROM nodes JOIN degrees USING (id) WHERE NOT {_FILE} AND NOT {_CONCEPT} AND NOT (lower(source_file) LIKE '%.json' AND lower(trim(label)) IN ({_noise(M.JSON_NOISE)})) AND label NOT IN ({_noise(M.ANALYSIS_NOISE)}) ORDER BY degree DESC, node_ord LIMIT 10",
        degrees=True,
    ),
    "god_nodes_query": graph(
        f"SELECT id, label, degree FROM nodes JOIN degrees USING (id) WHERE file_type <> 'concept' AND label NOT IN ({_noise(M.QUERY_NOISE)}) AND label <> regexp_extract(source_file, '[^/]*$') AND NOT (label LIKE '.%' AND label LIKE '%()') ORDER BY degree DESC, id LIMIT 10",
        degrees=True,
    ),
    "confidence_distribution": graph("SELECT confidence, count(*) AS n, (100 * count(*)) // greatest((SELECT count(*) FROM edges), 1) AS percent FROM edges GROUP BY confidence"),
    "graph_stats": graph(
        "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT community) FROM nodes) AS communities, (SELECT count(DISTINCT source_file) FROM nodes) AS files, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT relation) FROM edges) AS relations"
    ),
    "community_members": graph("SELECT community, count(*) AS size, substr(sha256(string_agg(id, chr(0) ORDER BY id) || chr(0)), 1, 16) AS fingerprint FROM nodes WHERE community IS NOT NULL GROUP BY community"),
    "community_cohesion": graph(
        """SELECT s.community, s.size, round(CAST(CASE WHEN s.size <= 1 THEN 1.0 ELSE coalesce(p.pairs, 0) / (s.size * (s.size - 1) / 2.0) END AS DOUBLE), 6) AS cohesion
           FROM (SELECT community, count(*) AS size FROM nodes WHERE community IS NOT NULL GROUP BY community) s
           LEFT JOIN (SELECT community, count(*) AS pairs FROM (SELECT DISTINCT a.community, least(src, tgt) AS x, greatest(src, tgt) AS y FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON tgt = b.id WHERE a.community = b.community AND src <> tgt) q GROUP BY community) p ON s.community = p.community"""
    ),
    "community_hub_label": graph(
        "SELECT community, id AS hub, regexp_replace(label, '\\(\\)$', '') AS label FROM (SELECT n.community, n.id, n.label, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, n.id) AS r FROM nodes n LEFT JOIN pd ON n.id = pd.id WHERE community IS NOT NULL) q WHERE r = 1",
        _PAIRS,
        degrees=True,
    ),
    "multigraph_diagnostics": graph(
        """SELECT (SELECT count(*) FROM dirty) AS raw_edges,
             (SELECT count(*) FROM dirty WHERE src NOT IN (SELECT id FROM nodes) OR tgt NOT IN (SELECT id FROM nodes)) AS dangling,
             (SELECT count(*) FROM dirty WHERE src = tgt) AS self_loops,
             CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM dirty GROUP BY src, tgt, relation) q) AS BIGINT) AS duplicate_keys,
             CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM dirty GROUP BY src, tgt) q) AS BIGINT) AS same_endpoint_extra,
             (SELECT count(*) FROM (SELECT 1 FROM dirty GROUP BY src, tgt HAVING count(DISTINCT relation) > 1) q) AS relation_variants,
             (SELECT count(*) FROM (SELECT 1 FROM dirty GROUP BY src, tgt HAVING count(DISTINCT source_file) > 1) q) AS file_variants,
             (SELECT count(*) FROM (SELECT 1 FROM dirty GROUP BY src, tgt HAVING count(DISTINCT context) > 1) q) AS context_variants""",
        DIRTY,
    ),
    "isolated_nodes": graph(f"SELECT id, label, degree FROM nodes JOIN degrees USING (id) WHERE degree <= 1 AND NOT {_FILE} AND NOT {_CONCEPT}", degrees=True),
    "community_reindex": graph(
        """SELECT n.id, r.new AS community FROM nodes n JOIN (SELECT community, row_number() OVER (ORDER BY size DESC, ids) - 1 AS new
             FROM (SELECT community, count(*) AS size, string_agg(id, chr(0) ORDER BY id) AS ids FROM nodes WHERE community IS NOT NULL GROUP BY community) q) r ON n.community = r.community"""
    ),
    "default_scores": graph("SELECT relation, confidence, count(*) AS n, round(CAST(sum(CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.5 ELSE 0.2 END) AS DOUBLE), 6) AS score FROM edges GROUP BY relation, confidence"),
}
