"""Extraction from tables, work memory, pull requests and exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.contract.measures import on_graph
from tessera.contract.star_sql import graph
from tessera.functions import sensitive, text
from tessera.operators import export as X
from tessera.operators import memory as M
from tessera.sources import documents, markup
from tessera.sources.star import stored_graph, table


def on(name, f):
    return lambda spark, d: f(table(spark, d, name))


def memory_docs(spark, d):
    """Outcomes of tasks by the labels of documents, each citing a supplier and a customer."""
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    outcome = F.when(F.col("toxic") == 1, "dead_end").when(F.col("quality") == 1, "useful").otherwise("corrected")
    node = lambda kind, n: F.concat(F.lit(f"{kind}:"), (F.col("doc_id") % n).cast("string"))
    return t.select(
        F.col("doc_id").alias("doc"), F.concat(F.lit("day "), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0")).alias("date"), F.concat(F.lit("how is "), "source").alias("question"), outcome.alias("outcome"),
        (60 - F.col("doc_id") % 60).cast("double").alias("age"), F.array(node("supplier", 10), node("customer", 97), node("supplier", 10), node("gone", 5)).alias("source_nodes"),
    )


DOCS = """
docs AS (SELECT doc_id AS doc, 'day ' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') AS date, 'how is ' || source AS question, CASE WHEN toxic = 1 THEN 'dead_end' WHEN quality = 1 THEN 'useful' ELSE 'corrected' END AS outcome, CAST(60 - doc_id % 60 AS DOUBLE) AS age,
  'supplier:' || (doc_id % 10) AS a, 'customer:' || (doc_id % 97) AS b, 'gone:' || (doc_id % 5) AS c FROM labels JOIN documents USING (doc_id)),
cited AS (SELECT doc, date, question, outcome, age, a AS node FROM docs UNION ALL SELECT doc, date, question, outcome, age, b FROM docs UNION ALL SELECT doc, date, question, outcome, age, c FROM docs),
scored AS (SELECT node, round(sum(CASE outcome WHEN 'useful' THEN 1 ELSE -1 END * pow(0.5, age / 30.0)), 9) AS score, count(*) FILTER (outcome = 'useful') AS pos, count(*) FILTER (outcome <> 'useful') AS neg FROM cited GROUP BY node)"""


def prs(spark, d):
    """Orders as pull requests."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    conclusion = F.when(k % 7 == 0, "TIMED_OUT").when(k % 7 < 5, "SUCCESS")
    checks = F.when(k % 11 == 0, F.array().cast("array<struct<status:string,conclusion:string>>")).otherwise(
        F.array(F.struct(F.when(k % 5 == 0, "QUEUED").otherwise("COMPLETED").alias("status"), conclusion.alias("conclusion")), F.struct(F.lit("COMPLETED").alias("status"), F.lit(None).cast("string").alias("conclusion")))
    )
    review = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "P", "CHANGES_REQUESTED")
    return o.select(k.alias("pr"), F.when(k % 13 == 0, "develop").otherwise("main").alias("base"), review.alias("review"), (k % 17 == 0).alias("draft"), (k % 30).alias("days"), M.ci_status(checks).alias("ci"))


PRS = """
prs AS (SELECT o_orderkey AS pr, CASE WHEN o_orderkey % 13 = 0 THEN 'develop' ELSE 'main' END AS base, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'CHANGES_REQUESTED' END AS review, o_orderkey % 17 = 0 AS draft, o_orderkey % 30 AS days,
  CASE WHEN o_orderkey % 11 = 0 THEN 'NONE' WHEN o_orderkey % 7 = 0 THEN 'FAILURE' WHEN o_orderkey % 5 = 0 THEN 'PENDING' WHEN o_orderkey % 7 < 5 THEN 'SUCCESS' ELSE 'NONE' END AS ci FROM orders)"""


def changes(spark, d):
    """Files that pull requests change, spelled from different roots."""
    n = table(spark, d, "nation").select("n_nationkey")
    part = lambda kind, name: n.select((F.col("n_nationkey") % 7).cast("long").alias("pr"), F.concat(F.lit(kind), F.col("n_nationkey").cast("string"), F.lit(name)).alias("file"))
    return part("repo/sales/n", "/customer.py").union(part("n", "/supplier.rs"))


CHANGES = """
changes AS (SELECT CAST(n_nationkey % 7 AS BIGINT) AS pr, 'repo/sales/n' || n_nationkey || '/customer.py' AS file FROM nation UNION SELECT CAST(n_nationkey % 7 AS BIGINT), 'n' || n_nationkey || '/supplier.rs' FROM nation)"""


def chunks(df, most=2000):
    def run(frames):
        for t in frames:
            for i, x in zip(t["doc_id"], t["text"]):
                yield pd.DataFrame([(i, k, a, b) for k, (a, b) in enumerate(text.slice_boundaries(x or "", most))], columns=["doc_id", "place", "first", "last"])

    return df.select("doc_id", "text").mapInPandas(run, "doc_id long, place long, first long, last long")


def packed(df, budget=6000):
    """WIN16: files of a source packed in order into chunks within a budget of tokens."""

    def run(key, t):
        out, chunk, used = [], 0, 0
        for i, n in t.sort_values("doc_id")[["doc_id", "tokens"]].itertuples(index=False):
            if used and used + n > budget:
                chunk, used = chunk + 1, 0
            used += n
            out.append((i, chunk, n))
        return pd.DataFrame(out, columns=["doc_id", "chunk", "tokens"])

    # Packing starts anew in each thousand of ids, so that a group stays bounded.
    sized = df.select("doc_id", "source", F.floor(F.col("doc_id") / 1000).alias("part"), text.file_tokens(F.length("text")).cast("long").alias("tokens"))
    return sized.groupBy("source", "part").applyInPandas(run, "doc_id long, chunk long, tokens long")


def ddl(spark, d):
    """DDL of the star schema as files, with the facts that are in it."""
    rows = [("star.sql", b"create table nation(k int, region int references region(k));\ncreate table customer(k int, nation int references nation(k)); -- create table no(x int)\ncreate view v as select * from customer join nation on true where note = 'from nowhere';\n")]
    return documents.facts(spark.createDataFrame(rows, "path string, content binary"))


def page_facts(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return documents.facts(p).groupBy("kind", "type").agg(F.count("*").alias("n"))


QUERIES = {
    "html_headings": on("pages", markup.html_headings),
    "html_heading_tree": on("pages", lambda p: markup.heading_tree(markup.html_headings(p))),
    "html_links": on("pages", markup.html_links),
    "page_facts": page_facts,
    "json_leaf_nodes": on("events", lambda e: markup.json_leaves(e, "event_id", "props")),
    "paper_signals": on("documents", lambda t: t.select("doc_id", sensitive.paper_signals(F.col("text")).alias("signals"))),
    "word_counts": on("documents", lambda t: t.select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))),
    "sensitive_values": on("documents", lambda t: markup.markdown_lines(t, "doc_id", "text").where(sensitive.assigned_secret(F.col("text"))).select("doc_id", "line")),
    "chunk_boundaries": on("documents", chunks),
    "chunk_packing": on("documents", packed),
    "sql_ddl_refs": ddl,
    "decayed_scores": lambda s, d: M.scores(memory_docs(s, d)),
    "lesson_buckets": lambda s, d: M.buckets(M.scores(memory_docs(s, d))),
    "outcome_counts": lambda s, d: M.outcome_counts(memory_docs(s, d)),
    "majority_community": lambda s, d: M.majority_community(memory_docs(s, d), stored_graph(s, d).nodes),
    "provenance_top5": lambda s, d: M.provenance(memory_docs(s, d)),
    "latest_dead_ends": lambda s, d: M.latest_dead_ends(memory_docs(s, d)),
    "ci_rollup": lambda s, d: prs(s, d).select("pr", "ci"),
    "pr_status": lambda s, d: prs(s, d).select("pr", M.pr_status("main", F.col("base"), F.col("ci"), F.col("review"), F.col("draft"), F.col("days")).alias("status")),
    "pr_impact": lambda s, d: M.pr_impact(changes(s, d), stored_graph(s, d).nodes),
    "cypher_lines": on_graph(X.cypher),
    "graphml_counts": on_graph(lambda g: X.graphml(g).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))),
    "canonical_graph": on_graph(lambda g: X.canonical(g)),
    "canonical_digest": on_graph(lambda g: X.digest(X.canonical(g))),
    "file_names": on_graph(lambda g: X.file_names(g.nodes)),
    "canvas_grid": on_graph(lambda g: X.grid(g.nodes)),
    "budget_cut": on_graph(lambda g: X.budget_cut(X.canonical(g), ["part", "line"], 500)),
    "label_propagation": on_graph(X.propagate),
}

_PAPER = " + ".join(f"CAST(regexp_matches(text, '{p}') AS BIGINT)" for p in sensitive.PAPER_SIGNALS)
_HEADS = r"""
heads AS (SELECT page_id, place - 1 AS place, CAST(substr(h, 3, 1) AS BIGINT) AS level, trim(regexp_replace(h, '<[^>]*>', '', 'g')) AS label FROM
  (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h1\b[^>]*>.*?</h1\s*>|<h2\b[^>]*>.*?</h2\s*>|<h3\b[^>]*>.*?</h3\s*>|<h4\b[^>]*>.*?</h4\s*>|<h5\b[^>]*>.*?</h5\s*>|<h6\b[^>]*>.*?</h6\s*>') AS hs FROM pages) q) u)"""
_ASSIGN = "regexp_replace(trim(line_text), '(?i)^export ', '')"

ORACLES = {
    "html_headings": f"WITH {_HEADS} SELECT page_id, CAST(place AS BIGINT) AS place, level, label FROM heads WHERE label <> ''",
    "html_heading_tree": f"WITH {_HEADS}, h AS (SELECT * FROM heads WHERE label <> '') SELECT a.page_id, CAST(a.place AS BIGINT) AS place, CAST(max(b.place) AS BIGINT) AS parent FROM h a LEFT JOIN h b ON a.page_id = b.page_id AND b.place < a.place AND b.level < a.level GROUP BY a.page_id, a.place",
    "html_links": r"""SELECT page_id, CAST(place - 1 AS BIGINT) AS place, trim(t) AS target FROM (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1) AS ts FROM pages) q) u WHERE trim(t) <> '' AND lower(trim(t)) NOT LIKE 'data:%'""",
    "json_leaf_nodes": "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE props LIKE '%\"k\"%'",
    "paper_signals": f"SELECT doc_id, {_PAPER} AS signals FROM documents",
    "word_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM documents",
    "sensitive_values": rf"""SELECT doc_id, CAST(line - 1 AS BIGINT) AS line FROM (SELECT doc_id, line, lower(regexp_replace(regexp_extract({_ASSIGN}, '^([^=:]*)[=:]', 1), '[^A-Za-z0-9]', '', 'g')) AS k, trim(regexp_extract({_ASSIGN}, '^[^=:]*[=:](.*)$', 1)) AS v
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) u) q
        WHERE k <> '' AND v <> '' AND k NOT IN ({", ".join(f"'{x}'" for x in sorted(sensitive.HARMLESS))}) AND (k IN ({", ".join(f"'{x}'" for x in sorted(sensitive.SECRET))}, 'auth') OR regexp_matches(k, '({"|".join(sensitive.SECRET_ENDS)})$'))""",
    "decayed_scores": f"WITH {DOCS} SELECT node, score, pos, neg FROM scored",
    "lesson_buckets": f"WITH {DOCS} SELECT node, CASE WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' ELSE 'tentative' END AS bucket, CASE WHEN pos > 0 AND neg > 0 THEN CASE WHEN score > 0 THEN 'useful' WHEN score < 0 THEN 'dead end' ELSE 'even' END END AS verdict, score FROM scored WHERE pos > 0",
    "outcome_counts": f"WITH {DOCS} SELECT outcome, count(*) AS n FROM docs GROUP BY outcome",
    "majority_community": graph(
        "SELECT d.doc, coalesce(m.c, 'Uncategorized') AS community FROM docs d LEFT JOIN (SELECT doc, c FROM (SELECT doc, CAST(community AS VARCHAR) AS c, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, CAST(community AS VARCHAR)) AS r FROM cited JOIN nodes ON node = id WHERE community IS NOT NULL GROUP BY doc, community) q WHERE r = 1) m ON d.doc = m.doc",
        DOCS,
    ),
    "provenance_top5": f"WITH {DOCS} SELECT node, r - 1 AS rank, date, question FROM (SELECT node, date, question, row_number() OVER (PARTITION BY node ORDER BY date DESC, question DESC) AS r FROM cited WHERE outcome IN ('useful', 'corrected')) q WHERE r <= 5",
    "latest_dead_ends": f"WITH {DOCS} SELECT question, date, doc FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY doc DESC) AS r FROM docs WHERE outcome = 'dead_end') q WHERE r = 1",
    "ci_rollup": f"WITH {PRS} SELECT pr, ci FROM prs",
    "pr_status": f"WITH {PRS} SELECT pr, CASE WHEN base <> 'main' THEN 'WRONG-BASE' WHEN ci = 'FAILURE' THEN 'CI-FAIL' WHEN review = 'CHANGES_REQUESTED' THEN 'CHANGES-REQ' WHEN draft THEN 'DRAFT' WHEN days >= 14 THEN 'STALE' WHEN review = 'APPROVED' THEN 'APPROVED' WHEN ci = 'PENDING' THEN 'PENDING' ELSE 'READY' END AS status FROM prs",
    "pr_impact": graph(
        """SELECT pr, string_agg(DISTINCT CAST(community AS VARCHAR), ',' ORDER BY community) AS communities, count(DISTINCT id) AS nodes FROM (SELECT DISTINCT c.pr, n.id, n.community FROM changes c JOIN nodes n ON n.source_file = c.file OR ends_with(n.source_file, '/' || c.file) OR ends_with(c.file, '/' || n.source_file)) q GROUP BY pr""",
        CHANGES,
    ).replace("string_agg(DISTINCT CAST(community AS VARCHAR), ',' ORDER BY community)", "array_to_string(list_sort(list_distinct(list(community))), ',')"),
    "cypher_lines": graph("SELECT 'MERGE (n:Node {id: ''' || id || '''}) SET n.label = ''' || replace(label, '''', '\\''') || ''';' AS line FROM nodes UNION ALL SELECT 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || tgt || '''}) MERGE (a)-[:' || upper(relation) || ']->(b);' FROM edges"),
    "graphml_counts": graph(
        """SELECT 'node' AS part, count(*) AS n, CAST(sum(length('<node id=""><data key="label"></data></node>') + length(id) + length(replace(replace(label, '&', '&amp;'), '#', '#'))) AS BIGINT) AS chars FROM nodes
           UNION ALL SELECT 'edge', count(*), CAST(sum(length('<edge source="" target=""><data key="relation"></data></edge>') + length(src) + length(tgt) + length(relation)) AS BIGINT) FROM edges"""
    ),
    "canonical_graph": graph("SELECT 'node' AS part, id || '|' || label || '|' || file_type || '|' || source_file AS line FROM nodes UNION ALL SELECT 'edge', src || '|' || tgt || '|' || relation FROM edges"),
    "file_names": graph(
        "SELECT id, CASE WHEN k = 0 THEN stem ELSE stem || '_' || k END AS name FROM (SELECT id, stem, row_number() OVER (PARTITION BY lower(stem) ORDER BY node_ord) - 1 AS k FROM (SELECT id, node_ord, replace(label, '#', '_') AS stem FROM nodes) q) u"
    ),
    "canvas_grid": graph(
        "SELECT id, CAST(k % side * 240 AS BIGINT) AS x, CAST(k // side * 240 AS BIGINT) AS y FROM (SELECT id, row_number() OVER (PARTITION BY community ORDER BY node_ord) - 1 AS k, CAST(ceil(sqrt(count(*) OVER (PARTITION BY community))) AS BIGINT) AS side FROM nodes WHERE community IS NOT NULL) q"
    ),
    "budget_cut": graph(
        "SELECT part, line FROM (SELECT part, line, sum(length(line) + 1) OVER (ORDER BY part, line ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT 'node' AS part, id || '|' || label || '|' || file_type || '|' || source_file AS line FROM nodes UNION ALL SELECT 'edge', src || '|' || tgt || '|' || relation FROM edges) q) u WHERE upto <= 1500"
    ),
}
