"""Graph JSON, paths and ids, seeds, ordering, audits and batches of facts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.contract.measures import on_graph
from tessera.contract.star_sql import graph
from tessera.functions import paths as P
from tessera.model import PropertyGraph, shared_folder
from tessera.operators import measures as M
from tessera.operators import repair as R
from tessera.operators import sets as S
from tessera.sources import graph_json
from tessera.sources.star import stored_graph, table
from tessera.streaming import journal

#: Names that are asked for; files, labels, parts of labels and names that nothing or too much has.
NAMES = ("customer:1", "france", "supply/n3/supplier.rs", "geo/region.md/", "nowhere", "Supplier#000000002()", "#000000005", "asia")


def json_files(spark, g):
    """The graph as JSON files under the names that older producers gave, 16 of them; calls have a score but no confidence."""
    folder = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(16)).alias("b")
    node = F.to_json(F.struct(F.col("id"), F.col("label").alias("name"), F.when(F.col("file_type") == "document", "markdown").otherwise(F.col("file_type")).alias("file_type"), F.col("source_file").alias("path"), "community"))
    call = F.col("relation") == "calls"
    edge = F.to_json(F.struct(F.col("src").alias("from"), F.col("tgt").alias("to"), F.col("relation").alias("type"), F.when(~call, F.col("confidence")).alias("confidence"), F.when(call, 0.5).alias("confidence_score"), "context"))
    lists = lambda df, c, r: df.select(bucket(c), r.alias("r")).groupBy("b").agg(F.array_join(F.collect_list("r"), ",").alias(c))
    both = lists(g.nodes, "id", node).join(lists(g.edges, "src", edge), "b", "full_outer")
    text = F.concat(F.lit('{"nodes": ['), F.coalesce("id", F.lit("")), F.lit(', {"label": "no id"}, 7], "edges": ['), F.coalesce("src", F.lit("")), F.lit(', {"from": "x"}]}'))
    both.select("b", F.regexp_replace(text, r"\[, ", "[").alias("value")).repartition("b").write.partitionBy("b").text(folder)
    return folder


def from_json(f):
    def run(spark, sf_dir):
        return f(graph_json.rows(spark, json_files(spark, stored_graph(spark, sf_dir))))

    return run


def seeds(g):
    asked = g.nodes.sparkSession.createDataFrame([(n,) for n in NAMES], "query string")
    return R.resolve_seeds(g.nodes, asked)


def both_ways(g):
    """Calls in both directions, the second ones later."""
    e = g.edges.where("relation = 'calls'").select("src", "tgt", "relation").withColumn("ord", F.lit(1))
    return e.unionByName(e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "relation", F.lit(2).alias("ord")))


def versions(g):
    """A base, a version with other labels for nation 2, and one whose part calls are references."""
    ours = g.nodes.withColumn("label", F.when(F.col("community") == 2, F.upper("label")).otherwise(F.col("label")))
    theirs = g.edges.withColumn("relation", F.when(F.col("relation") == "uses", "references").otherwise(F.col("relation")))
    return g, PropertyGraph(ours, g.edges.limit(0)), PropertyGraph(g.nodes.limit(0), theirs)


def worse(g):
    """The graph with nodes of one community twice, parts of another gone, loops, and labels lost."""
    n = g.nodes.where("community is null or community <> 4").unionByName(g.nodes.where("community = 5"))
    n = n.withColumn("label", F.when(F.col("community") == 6, "").otherwise(F.col("label")))
    return PropertyGraph(n, g.edges.unionByName(g.edges.where("relation = 'contains'").withColumn("src", F.col("tgt"))))


def listed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*[F.lit(x) for x in R.PR_ORDER[1:]]), (F.pmod("o_orderkey", F.lit(7)) + 1).cast("int"))
    return R.pr_listing(o.select(F.col("o_orderkey").alias("pr"), F.when(F.col("o_orderstatus") == "F", "main").otherwise("next").alias("base"), status.alias("status"), F.pmod("o_custkey", F.lit(40)).cast("long").alias("days")), "main")


def batches(g):
    rows = g.nodes.where("community is not null").select("id", "community", "node_ord", "label")
    return journal.split_facts(rows, "community", "node_ord", F.octet_length("label"), 100, 1000).select("id", "batch")


QUERIES = {
    "graph_json_nodes": from_json(lambda r: graph_json.graph(r).nodes.select("id", "label", "file_type", "source_file", "community")),
    "graph_json_edges": from_json(lambda r: graph_json.graph(r).edges.select("src", "tgt", "relation", "confidence", "context")),
    "ingest_issues": from_json(graph_json.issues),
    "seed_resolution": on_graph(seeds),
    "id_prefixes": on_graph(lambda g: g.nodes.select("source_file").distinct().select("source_file", F.explode(P.id_prefixes(F.col("source_file"))).alias("prefix"))),
    "path_names": on_graph(lambda g: g.nodes.select("source_file").distinct().select("source_file", P.stem(F.col("source_file")).alias("stem"), P.path_key(F.concat(F.lit("./"), F.upper("source_file"))).alias("key"), P.relative(F.col("source_file"), "sales").alias("below"), P.is_remote(F.concat(F.lit("http://"), "source_file")).alias("remote"))),
    "origin_tiers": lambda spark, d: table(spark, d, "documents").select("doc_id", P.is_structural(F.element_at(F.array(F.lit("ast"), F.lit("semantic"), F.lit("other")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))).alias("structural")),
    "body_contents": lambda spark, d: table(spark, d, "documents").select("doc_id", F.md5(P.body_content(F.concat(F.lit("---\nlang: x\n---\n"), F.coalesce("text", F.lit(""))))).alias("digest")),
    "id_remap": on_graph(lambda g: R.id_remap(g.nodes.select(F.concat(F.element_at(P.id_prefixes(F.col("source_file")), -1), F.lit("_"), F.replace(F.col("id"), F.lit(":"), F.lit("_"))).alias("id"), "source_file"))),
    "collapse_reverse": on_graph(lambda g: R.collapse_reverse(both_ways(g), "ord").select("src", "tgt", "relation")),
    "merge_three_nodes": on_graph(lambda g: R.merge_three(*versions(g)).nodes.select("id", "label")),
    "merge_three_edges": on_graph(lambda g: R.merge_three(*versions(g)).edges.select("src", "tgt", "relation")),
    "sorted_distinct_edges": on_graph(lambda g: R.sorted_distinct(PropertyGraph(g.nodes, g.edges.unionByName(g.edges))).edges.select("src", "tgt", "relation")),
    "first_labels": on_graph(lambda g: R.first_labels(g.nodes, 3)),
    "label_batches": on_graph(lambda g: R.label_batches(g.nodes, M.degrees(g), 10, 3)),
    "pr_listing": listed,
    "edge_of_pairs": on_graph(lambda g: R.edge_of_pairs(g.edges.where("relation = 'uses'").select(F.col("tgt").alias("a"), F.col("src").alias("b")), g.edges.withColumn("ord", F.lit(1)), "ord")),
    "project_overview": on_graph(lambda g: R.overview(g, M.degrees(g), 5)),
    "audit_findings": on_graph(lambda g: R.audit(worse(g))),
    "fact_batches": on_graph(batches),
    "filled_nodes": on_graph(lambda g: R.fill_missing(g.nodes.select("source_file", F.when(F.col("node_ord") % 3 == 0, F.col("label")).alias("label"), "community", "node_ord"), "source_file", "node_ord", ["label", "community"])),
    "community_names": on_graph(lambda g: R.remapped(g.nodes.select("id", "community"), S.match_communities(S.community_overlap(g.nodes.where("community is not null"), g.nodes.where("community is not null")), g.nodes.where("community is not null")), g.nodes.where("community is not null").groupBy("community").agg(F.min("label").alias("community_name"))).select("id", "community", "community_name")),
}

_VALUES = ", ".join(f"('{n}')" for n in NAMES)
_PREFIXES = """
parts AS (SELECT DISTINCT source_file, list_filter(list_transform(string_split(regexp_replace(source_file, '\\.[^./]*$', ''), '/'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_')), lambda x: x <> '') AS p FROM nodes),
prefixes AS (SELECT source_file, p, array_to_string(p[k:], '_') AS prefix FROM (SELECT source_file, p, unnest(range(1, len(p) + 1)) AS k FROM parts) q)"""
_SEEDS = f"""
q AS (SELECT col0 AS query, regexp_replace(col0, '/+$', '') AS q0 FROM (VALUES {_VALUES}) v),
k AS (SELECT query, q0, lower(q0) AS qn, regexp_replace(lower(q0), '\\(\\)$', '') AS qb, regexp_extract(lower(q0), '[^/]*$') AS base FROM q),
n AS (SELECT id, lower(label) AS norm, regexp_replace(lower(label), '\\(\\)$', '') AS bare, lower(source_file) AS f FROM nodes),
tiers AS (
  SELECT query, id, 0 AS tier FROM k JOIN n ON q0 = id UNION ALL SELECT query, id, 1 FROM k JOIN n ON qn = norm UNION ALL SELECT query, id, 2 FROM k JOIN n ON qb = bare
  UNION ALL SELECT query, id, 3 FROM k JOIN n ON qn = f UNION ALL SELECT query, id, 4 FROM k JOIN n ON qn = f AND norm = base UNION ALL SELECT query, id, 9 FROM k JOIN n ON contains(norm, qn)),
lone AS (SELECT query, tier, min(id) AS id FROM tiers GROUP BY query, tier HAVING count(*) = 1)"""
_WORSE = """
wn AS (SELECT id, CASE WHEN community = 6 THEN '' ELSE label END AS label, source_file FROM nodes WHERE community IS NULL OR community <> 4 UNION ALL SELECT id, label, source_file FROM nodes WHERE community = 5),
we AS (SELECT src, tgt FROM edges UNION ALL SELECT tgt, tgt FROM edges WHERE relation = 'contains')"""
_ROWS = "community IS NOT NULL"

ORACLES = {
    "graph_json_nodes": graph("SELECT id, label, file_type, source_file, community FROM nodes"),
    "graph_json_edges": graph("SELECT src, tgt, relation, CASE WHEN relation = 'calls' THEN 'INFERRED' ELSE confidence END AS confidence, context FROM edges"),
    # Each of the 16 files has one row of each kind that is wrong.
    "ingest_issues": "SELECT * FROM (VALUES ('node', 'no id', 16), ('node', 'no object', 16), ('link', 'no end', 16), ('link', 'no relation', 16)) v(part, cause, n)",
    "seed_resolution": graph("SELECT query, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier) AS r FROM lone) x WHERE r = 1", _SEEDS),
    "id_prefixes": graph("SELECT source_file, prefix FROM prefixes", _PREFIXES),
    "path_names": graph("SELECT DISTINCT source_file, regexp_replace(source_file, '\\.[^./]*$', '') AS stem, lower(source_file) AS key, CASE WHEN source_file LIKE 'sales/%' THEN substr(source_file, 7) ELSE source_file END AS below, true AS remote FROM nodes"),
    "origin_tiers": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS structural FROM documents",
    "body_contents": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "id_remap": graph(
        "SELECT old, min(new) AS new FROM (SELECT p[len(p)] || '_' || replace(id, ':', '_') AS old, array_to_string(p, '_') || '_' || replace(id, ':', '_') AS new FROM nodes JOIN parts USING (source_file) WHERE len(p) > 1) x GROUP BY old HAVING count(DISTINCT new) = 1", _PREFIXES
    ),
    "collapse_reverse": graph("SELECT src, tgt, relation FROM edges WHERE relation = 'calls'"),
    "merge_three_nodes": graph("SELECT id, CASE WHEN community = 2 THEN upper(label) ELSE label END AS label FROM nodes"),
    "merge_three_edges": graph("SELECT src, tgt, relation FROM edges UNION SELECT src, tgt, CASE WHEN relation = 'uses' THEN 'references' ELSE relation END FROM edges"),
    "sorted_distinct_edges": graph("SELECT DISTINCT src, tgt, relation FROM edges"),
    "first_labels": graph(f"SELECT community, r AS rank, label FROM (SELECT community, CASE WHEN label = '' THEN id ELSE label END AS label, row_number() OVER (PARTITION BY community ORDER BY node_ord) AS r FROM nodes WHERE {_ROWS}) q WHERE r <= 3"),
    "label_batches": graph(
        "SELECT batch, community, size, leads FROM (SELECT community, count(*) AS size, (row_number() OVER (ORDER BY count(*) DESC, community) - 1) // 10 AS batch FROM nodes WHERE community IS NOT NULL GROUP BY community) s JOIN led USING (community)",
        "led AS (SELECT community, string_agg(label, '; ' ORDER BY r) AS leads FROM (SELECT community, label, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS r FROM nodes JOIN degrees USING (id) WHERE community IS NOT NULL) q WHERE r <= 3 GROUP BY community)", degrees=True,
    ),
    "pr_listing": """
      SELECT pr, status, days, row_number() OVER (ORDER BY place, days, pr) AS rank FROM (
        SELECT o_orderkey AS pr, o_orderkey % 7 AS place, ['CI-FAIL', 'CHANGES-REQ', 'DRAFT', 'STALE', 'PENDING', 'APPROVED', 'READY'][o_orderkey % 7 + 1] AS status, CAST(o_custkey % 40 AS BIGINT) AS days
        FROM orders WHERE o_orderstatus = 'F') q""",
    "edge_of_pairs": graph("SELECT tgt AS a, src AS b, src, tgt, relation FROM edges WHERE relation = 'uses'"),
    "project_overview": graph(
        "SELECT 'count' AS kind, 'nodes' AS name, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'count', 'edges', (SELECT count(*) FROM edges) UNION ALL SELECT 'count', 'communities', (SELECT count(DISTINCT community) FROM nodes)"
        " UNION ALL SELECT * FROM (SELECT 'hub', id, degree FROM degrees ORDER BY degree DESC, id LIMIT 5) h UNION ALL SELECT * FROM (SELECT 'file', source_file, count(*) FROM nodes WHERE source_file <> '' GROUP BY source_file ORDER BY count(*) DESC, source_file LIMIT 5) f", degrees=True,
    ),
    "audit_findings": graph(
        "SELECT * FROM (SELECT 'warning' AS severity, 'node.label' AS code, count(*) AS n FROM wn WHERE label = '' UNION ALL SELECT 'error', 'node.duplicate', count(*) FROM (SELECT id FROM wn GROUP BY id HAVING count(*) > 1) d UNION ALL SELECT 'warning', 'edge.loop', count(*) FROM we WHERE src = tgt"
        " UNION ALL SELECT 'error', 'edge.src', count(*) FROM we WHERE src NOT IN (SELECT id FROM wn) UNION ALL SELECT 'error', 'edge.tgt', count(*) FROM we WHERE tgt NOT IN (SELECT id FROM wn)) a WHERE n > 0", _WORSE,
    ),
    "fact_batches": graph(
        "SELECT id, dense_rank() OVER (PARTITION BY community ORDER BY step) - 1 AS batch FROM (SELECT id, community, greatest((row_number() OVER w - 1) // 100, coalesce(sum(strlen(label)) OVER (PARTITION BY community ORDER BY node_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000) AS step"
        " FROM nodes WHERE community IS NOT NULL WINDOW w AS (PARTITION BY community ORDER BY node_ord)) q"
    ),
    "filled_nodes": graph(
        "SELECT source_file, min(node_ord) AS node_ord, arg_min(label, node_ord) FILTER (node_ord % 3 = 0) AS label, arg_min(community, node_ord) FILTER (community IS NOT NULL) AS community FROM nodes GROUP BY source_file"
    ),
    "community_names": graph("SELECT id, community, community_name FROM nodes LEFT JOIN (SELECT community AS c, min(label) AS community_name FROM nodes WHERE community IS NOT NULL GROUP BY community) x ON community = c"),
}
