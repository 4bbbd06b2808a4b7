"""Filters, set operations, incremental maintenance and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.contract.measures import on_graph
from tessera.contract.star_sql import graph
from tessera.functions.text import micros
from tessera.model import PropertyGraph, shared_folder
from tessera.operators import sets as S
from tessera.sources.star import stored_graph, table
from tessera.streaming import merge


def second(g):
    """A later version: nation 3 lost its customers, a supplier is new, some uses have become references."""
    lost = g.nodes.where("community = 3 and id like 'customer:%'").select("id")
    new = g.nodes.limit(0).unionByName(g.nodes.sparkSession.createDataFrame([("supplier:new", "Supplier#new", "code", "supply/n1/supplier.rs", 1, 0)], "id string, label string, file_type string, source_file string, community long, node_ord long"))
    nodes = g.nodes.join(lost, "id", "left_anti").unionByName(new)
    e = g.edges.join(lost, g.edges.src == lost.id, "left_anti")
    e = e.join(lost, e.tgt == lost.id, "left_anti")
    flip = (F.col("relation") == "uses") & F.endswith("tgt", F.lit("00"))
    return PropertyGraph(nodes, e.withColumn("relation", F.when(flip, "references").otherwise(F.col("relation"))))


V2 = """
lost AS (SELECT id FROM nodes WHERE community = 3 AND id LIKE 'customer:%'),
nodes2 AS (SELECT id, label, source_file, community FROM nodes WHERE id NOT IN (SELECT id FROM lost) UNION ALL SELECT 'supplier:new', 'Supplier#new', 'supply/n1/supplier.rs', 1),
edges2 AS (SELECT src, tgt, CASE WHEN relation = 'uses' AND tgt LIKE '%00' THEN 'references' ELSE relation END AS relation FROM edges WHERE src NOT IN (SELECT id FROM lost) AND tgt NOT IN (SELECT id FROM lost))"""


def halves(g):
    """Two repos: nations of even and odd keys with all below, regions as nodes without a file in both."""
    side = F.col("community") % 2
    regions = g.nodes.where("id like 'region:%'").withColumn("source_file", F.lit(""))

    def half(k):
        nodes = g.nodes.where(side == k).unionByName(regions)
        ids = nodes.select("id")
        e = g.edges.join(ids, g.edges.src == ids.id, "left_semi")
        return PropertyGraph(nodes, e.join(ids, e.tgt == ids.id, "left_semi"))

    return half(0), half(1)


HALVES = ", ".join(
    f"n{k} AS (SELECT id, label, source_file FROM nodes WHERE community % 2 = {k} UNION ALL SELECT id, label, '' FROM nodes WHERE id LIKE 'region:%'), e{k} AS (SELECT src, tgt, relation FROM edges WHERE src IN (SELECT id FROM n{k}) AND tgt IN (SELECT id FROM n{k}))"
    for k in (0, 1)
)


def store(g):
    even, odd = halves(g)
    empty = S.prefixed(PropertyGraph(g.nodes.limit(0), g.edges.limit(0)), "none")
    return S.global_add(S.global_add(empty, even, "even"), odd, "odd")


def merged(g):
    even, odd = halves(g)
    return S.union(S.prefixed(even, "even"), S.prefixed(odd, "odd"))


def written(g):
    """Edges as producers wrote them: each again by a later one with another confidence."""
    e = g.edges.select("src", "tgt", "relation", "confidence").withColumn("ord", F.lit(1))
    again = e.where(F.endswith("tgt", F.lit("7"))).withColumns({"confidence": F.lit("AMBIGUOUS"), "ord": F.lit(2)})
    return e.unionByName(again)


def facts(g, ord_):
    return g.nodes.select("id", "label", "source_file", F.when(F.col("file_type") == "code", "ast").otherwise("semantic").alias("tier"), F.lit(ord_).cast("long").alias("ord"))


def renewed(g):
    """Facts of the files of nations 1 to 4, extracted anew with other labels."""
    return facts(g, 2).where("source_file rlike '^(sales|supply)/n[1-4]/'").withColumn("label", F.upper("label"))


RENEWED = """
facts AS (SELECT id, label, source_file, CASE WHEN file_type = 'code' THEN 'ast' ELSE 'semantic' END AS tier FROM nodes),
renewed AS (SELECT id, upper(label) AS label, source_file, tier FROM facts WHERE regexp_matches(source_file, '^(sales|supply)/n[1-4]/'))"""


def manifest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    state = lambda d: d.groupBy(F.concat(F.lit("u"), "user_id", F.lit("/"), "event_type").alias("path")).agg(F.max(micros(F.col("ts"))).alias("mtime"), F.round(F.max("value"), 2).cast("string").alias("hash"))
    return S.manifest_delta(state(e.where(day < "2024-01-15")), state(e.where(day >= "2024-01-10")))


def stream_merge(spark, sf_dir):
    """Facts arrive in two files of one stream, the second with newer facts of some sources, and meet in one state."""
    g = stored_graph(spark, sf_dir)
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    facts(g, 1).coalesce(1).write.parquet(f"{root}/in/one")
    schema = spark.read.parquet(f"{root}/in/one").schema
    merge.merge_stream(spark, f"{root}/in/*", schema, f"{root}/state", f"{root}/check")
    renewed(g).coalesce(1).write.parquet(f"{root}/in/two")
    merge.merge_stream(spark, f"{root}/in/*", schema, f"{root}/state", f"{root}/check")
    return merge.latest(spark, f"{root}/state").select("id", "label", "source_file", "tier")


def debounced(spark, sf_dir):
    return S.debounce(table(spark, sf_dir, "events").select("user_id", micros(F.col("ts")).alias("t")), "user_id", "t", 3_600_000_000, 7_200_000_000).select("user_id", "session", "part", "first", "last", "n")


def family(filters):
    return on_graph(lambda g: S.context_filter(g.edges, filters).select("src", "tgt", "relation"))


def moved(g):
    """Another clustering: parts move on by one."""
    return g.nodes.where("community is not null").select("id", F.when(F.col("file_type") == "document", (F.col("community") + 1) % 25).otherwise(F.col("community")).alias("community"))


QUERIES = {
    "context_filter_call": family(["call"]),
    "context_filter_import": family(["imports"]),
    "context_filter_type": family(["types", "argument"]),
    "context_filter_structure": family(["structure"]),
    "dangling_edges": on_graph(lambda g: S.dangling(PropertyGraph(g.nodes.where("community is null or community <> 7"), g.edges))),
    "duplicate_nodes": on_graph(lambda g: S.repeated_ids(g.nodes.unionByName(g.nodes.where("community = 2")))),
    "graph_diff_nodes": on_graph(lambda g: S.node_diff(g.nodes, second(g).nodes)),
    "graph_diff_edges": on_graph(lambda g: S.edge_diff(g.edges, second(g).edges)),
    "merge_repos": on_graph(lambda g: merged(g).nodes.select("id", "label", "repo", "local_id")),
    "global_add": on_graph(lambda g: store(g).nodes.select("id", "label", "repo")),
    "global_add_edges": on_graph(lambda g: store(g).edges.select("src", "tgt", "relation")),
    "global_remove": on_graph(lambda g: S.prune_repo(merged(g), "even").edges.select("src", "tgt", "relation")),
    "last_write_edges": on_graph(lambda g: S.keep_one(written(g), ["src", "tgt", "relation"], F.col("ord"), True).select("src", "tgt", "relation", "confidence")),
    "raw_dedupe_edges": on_graph(lambda g: S.keep_one(written(g), ["src", "tgt", "relation"], F.col("ord"), False).select("src", "tgt", "relation", "confidence")),
    "raw_dedupe_nodes": on_graph(lambda g: S.keep_one(facts(g, 1).unionByName(renewed(g)), ["id"], F.col("ord"), True).select("id", "label")),
    "replace_by_source": on_graph(lambda g: S.replace_by_source(facts(g, 1), renewed(g)).select("id", "label", "source_file", "tier")),
    "prune_sources": on_graph(lambda g: S.prune_sources(g, g.nodes.where("source_file like 'sales/n1%'").select("source_file").distinct()).edges.select("src", "tgt", "relation")),
    "manifest_delta": manifest,
    "community_overlap": on_graph(lambda g: S.community_overlap(g.nodes.where("community is not null"), moved(g))),
    "community_match": on_graph(lambda g: S.match_communities(S.community_overlap(g.nodes.where("community is not null"), moved(g)), moved(g))),
    "shrink_guard": on_graph(lambda g: S.shrink_guard(g.nodes, second(g).nodes, g.nodes.where("source_file = 'sales/n3/customer.py'").select("source_file").distinct())),
    "stream_merge": stream_merge,
    "debounce_batches": debounced,
    "event_windows": lambda spark, d: merge.windowed_counts(table(spark, d, "events")).withColumn("start", micros(F.col("start"))),
}

_REPLACED = "SELECT id, label, source_file, tier FROM facts WHERE (source_file, tier) NOT IN (SELECT source_file, tier FROM renewed) UNION ALL SELECT id, label, source_file, tier FROM renewed"
_WRITTEN = "written AS (SELECT src, tgt, relation, confidence, 1 AS ord FROM edges UNION ALL SELECT src, tgt, relation, 'AMBIGUOUS', 2 FROM edges WHERE tgt LIKE '%7')"
_MERGED = "mn AS (SELECT 'even::' || id AS id, label, 'even' AS repo, id AS local_id, source_file FROM n0 UNION ALL SELECT 'odd::' || id, label, 'odd', id, source_file FROM n1), me AS (SELECT 'even::' || src AS src, 'even::' || tgt AS tgt, relation FROM e0 UNION ALL SELECT 'odd::' || src, 'odd::' || tgt, relation FROM e1)"
#: Regions of the second repo fold onto those of the first.
_FOLD = "CASE WHEN {0} LIKE 'odd::region:%' THEN replace({0}, 'odd::', 'even::') ELSE {0} END"


def _pick(order):
    return f"SELECT src, tgt, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, relation ORDER BY ord {order}) AS r FROM written) q WHERE r = 1"


ORACLES = {
    "context_filter_call": graph("SELECT src, tgt, relation FROM edges WHERE relation = 'calls' OR context = 'invocation'"),
    "context_filter_import": graph("SELECT src, tgt, relation FROM edges WHERE relation IN ('imports', 'imports_from', 're_exports')"),
    "context_filter_type": graph("SELECT src, tgt, relation FROM edges WHERE relation IN ('references', 'inherits', 'implements', 'type_ref') OR context = 'params'"),
    "context_filter_structure": graph("SELECT src, tgt, relation FROM edges WHERE relation IN ('contains', 'method', 'case_of')"),
    "dangling_edges": graph(
        "SELECT src, tgt, relation, 'src' AS \"end\" FROM edges WHERE src IN (SELECT id FROM nodes WHERE community = 7) UNION ALL SELECT src, tgt, relation, 'tgt' FROM edges WHERE tgt IN (SELECT id FROM nodes WHERE community = 7)"
    ),
    "duplicate_nodes": graph("SELECT id, CAST(2 AS BIGINT) AS n FROM nodes WHERE community = 2"),
    "graph_diff_nodes": graph("SELECT 'added' AS change, id, label FROM nodes2 WHERE id NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'removed', id, label FROM nodes WHERE id NOT IN (SELECT id FROM nodes2)", V2),
    "graph_diff_edges": graph(
        "SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y",
        V2, "a AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, relation FROM edges)", "b AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, relation FROM edges2)",
    ),
    "merge_repos": graph("SELECT id, label, repo, local_id FROM mn", HALVES, _MERGED),
    "global_add": graph("SELECT id, label, repo FROM mn WHERE id NOT LIKE 'odd::region:%'", HALVES, _MERGED),
    "global_add_edges": graph(f"SELECT DISTINCT {_FOLD.format('src')} AS src, {_FOLD.format('tgt')} AS tgt, relation FROM me WHERE src <> tgt", HALVES, _MERGED),
    "global_remove": graph("SELECT src, tgt, relation FROM me WHERE src LIKE 'odd::%'", HALVES, _MERGED),
    "last_write_edges": graph(_pick("DESC"), _WRITTEN),
    "raw_dedupe_edges": graph(_pick("ASC"), _WRITTEN),
    "raw_dedupe_nodes": graph("SELECT f.id, coalesce(r.label, f.label) AS label FROM facts f LEFT JOIN renewed r ON f.id = r.id", RENEWED),
    "replace_by_source": graph(_REPLACED, RENEWED),
    "prune_sources": graph(
        "SELECT src, tgt, relation FROM edges WHERE source_file NOT LIKE 'sales/n1%' AND src NOT IN (SELECT id FROM nodes WHERE source_file LIKE 'sales/n1%') AND tgt NOT IN (SELECT id FROM nodes WHERE source_file LIKE 'sales/n1%')"
    ),
    "manifest_delta": """
      WITH b AS (SELECT 'u' || user_id || '/' || event_type AS path, max(epoch_us(ts)) AS m, max(value) AS h FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15' GROUP BY 1),
           n AS (SELECT 'u' || user_id || '/' || event_type AS path, max(epoch_us(ts)) AS m, max(value) AS h FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' GROUP BY 1)
      SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN b.m = n.m THEN 'unchanged' WHEN b.h = n.h THEN 'touched' ELSE 'changed' END AS status
      FROM b FULL OUTER JOIN n ON b.path = n.path""",
    "community_overlap": graph("SELECT community AS old, CASE WHEN file_type = 'document' THEN (community + 1) % 25 ELSE community END AS new, count(*) AS n FROM nodes WHERE community IS NOT NULL GROUP BY 1, 2"),
    "shrink_guard": graph(
        "SELECT count(*) AS lost, count(*) FILTER (source_file = 'sales/n3/customer.py') AS explained, count(*) > count(*) FILTER (source_file = 'sales/n3/customer.py') AS refused FROM nodes WHERE id NOT IN (SELECT id FROM nodes2)", V2
    ),
    "stream_merge": graph(_REPLACED, RENEWED),
    "debounce_batches": """
      WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
           f AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 3600000000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
           s AS (SELECT user_id, t, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f),
           p AS (SELECT *, (t - min(t) OVER (PARTITION BY user_id, session)) // 7200000000 AS part FROM s)
      SELECT user_id, session, CAST(part AS BIGINT) AS part, min(t) AS first, max(t) AS last, count(*) AS n FROM p GROUP BY user_id, session, part""",
    "event_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
}
