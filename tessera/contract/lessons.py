"""Saved answers and what they teach, safety of URLs and texts, contexts of questions, and bindings by language."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.contract.measures import on_graph
from tessera.contract.records import DOCS, memory_docs, on
from tessera.contract.star_sql import graph
from tessera.functions import safety as Y

from tessera.operators import ask as K
from tessera.operators import languages as L
from tessera.operators import lessons as N
from tessera.operators import memory as M
from tessera.sources.scopes import COLUMNS
from tessera.sources.star import stored_graph, table


def answers(spark, d):
    """Answers about documents; questions hold quotes, tabs and backslashes."""
    t = memory_docs(spark, d)
    c = F.col
    at = F.timestamp_seconds(F.lit(1704067200) + c("doc"))
    fix = F.when(c("outcome") == "corrected", F.concat(F.lit("see "), "question"))
    some = F.when(c("doc") % 4 == 0, F.array().cast("array<string>")).otherwise(F.slice("source_nodes", 1, 2))
    return t.select(F.lit("query").alias("type"), at.alias("at"), F.concat("question", F.lit(' "\t\\ of '), c("doc").cast("string")).alias("question"), F.concat(F.lit("answer "), c("doc").cast("string")).alias("answer"), F.when(c("doc") % 5 != 0, c("outcome")).alias("outcome"), fix.alias("correction"), some.alias("source_nodes"))


def reread(spark, d):
    files = N.saved(answers(spark, d)).select(F.concat(F.lit("memory/"), "name").alias("path"), F.col("text").alias("content"))
    return N.memory_docs(files).select("path", "question", "outcome", "correction", F.array_join("source_nodes", ",").alias("nodes"), "date")


def hashes(g, changed: bool):
    """A hash of each file; later, those of nation 3 differ and those of nation 4 are gone."""
    h = g.nodes.select("source_file").distinct().withColumn("hash", F.md5("source_file"))
    if not changed:
        return h
    return h.where("source_file not like '%/n4/%'").withColumn("hash", F.when(F.contains("source_file", F.lit("/n3/")), F.lit("new")).otherwise(F.col("hash")))


def marked(spark, d):
    """Lessons as citers name their nodes: customers by id, suppliers by label."""
    g = stored_graph(spark, d)
    names = g.nodes.where("id like 'supplier:%'").select(F.col("id").alias("node"), "label")
    b = M.buckets(M.scores(memory_docs(spark, d))).join(names, "node", "left").withColumn("node", F.coalesce("label", "node")).drop("label")
    return g, N.overlay(b, g.nodes, hashes(g, False))


def staleness(spark, d):
    g, m = marked(spark, d)
    return N.stale(m, hashes(g, True)).select("id", "bucket", "source_file", "stale")


def on_nodes(spark, d):
    g, m = marked(spark, d)
    return N.with_overlay(g.nodes.select("id", "label"), N.stale(m, hashes(g, True))).select("id", "label", "bucket", "stale")


def citations(spark, d):
    return N.known_citations(memory_docs(spark, d), stored_graph(spark, d).nodes).select("doc", F.array_join("source_nodes", ",").alias("nodes"))


_URLS = ("ftp://example.com/x", "http://127.0.0.1/", "https://10.1.2.3:8443/x", "http://[::ffff:192.168.0.1]/", "http://metadata.google.internal/v1", "http://100.64.1.1/", "https://8.8.8.8/dns", "http://")


def urls(p):
    other = F.element_at(F.array(*[F.lit(u) for u in _URLS]), (F.col("page_id") % 16 + 1).cast("int"))
    tried = F.when(F.col("page_id") % 16 < len(_URLS), other).otherwise(F.concat(F.lit("https://example.com/"), F.col("page_id").cast("string")))
    return p.select("page_id", tried.alias("url")).select("page_id", "url", Y.url_problem_udf("url").alias("problem"))


def metadata(t):
    text = F.to_json(F.struct(F.concat(F.lit("<a>"), F.col("lang"), F.lit("\t\u0001")).alias("x"), F.array_repeat(F.lit("&"), 60).alias("y"), F.struct(F.repeat(F.lit("z"), 600).alias("k")).alias("m")))
    return t.select("doc_id", Y.clean_metadata_udf(text).alias("meta"))


def signs(t):
    label = F.concat(F.lit("get_"), F.col("lang"), F.lit(".x1 of"), F.col("doc_id").cast("string"), F.lit("(arg)"))
    found = F.concat(F.lit("Result: "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, " nodes found").otherwise(" node lost"))
    link = F.when(F.col("doc_id") % 3 == 0, "https://u:p@h/x").when(F.col("doc_id") % 3 == 1, "https://u@h/x").otherwise("https://:p@h")
    token = F.when(F.col("doc_id") % 2 == 0, " eyJhbGci.e30.c2ln ").otherwise("eyJhbGci.e30")
    return t.where("lang is not null").select("doc_id", F.array_join(Y.label_identifiers(label), ",").alias("names"), Y.nodes_found(found).alias("n"), Y.has_credentials(link).alias("credentials"), Y.is_jwt(token).alias("jwt"), Y.make_id(F.lit("_a."), F.lit("."), F.col("lang")).alias("id"))


def scope_rows(spark, d):
    """Nations as base types with methods; suppliers as types in another package, two thirds of which import their nation's."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    s = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    text = lambda c: F.col(c).cast("long").cast("string")
    space, base = F.concat(F.lit("geo.r"), text("n_regionkey")), F.concat(F.lit("Nation"), text("n_nationkey"))
    own, sfile, nfile = F.concat(F.lit("Sup"), text("s_suppkey")), F.concat(F.lit("s"), text("s_suppkey"), F.lit(".java")), F.concat(F.lit("n"), text("n_nationkey"), F.lit(".java"))

    def rows(df, file, kind, namespace, **values):
        given = {"source_file": file, "language": F.lit("java"), "kind": F.lit(kind), "namespace": namespace, "line": F.lit(1).cast("long"), **values}
        return df.select(*[given.get(c, F.lit("")).alias(c) for c in COLUMNS])

    sup = F.lit("sup")
    out = rows(n, nfile, "type", space, name=base).unionByName(rows(n, nfile, "method", space, owner=base, name=F.lit("trade")))
    out = out.unionByName(rows(s, sfile, "type", sup, name=own)).unionByName(rows(s, sfile, "base", sup, owner=own, name=base, relation=F.lit("inherits")))
    out = out.unionByName(rows(s.where("s_suppkey % 3 <> 0"), sfile, "import", sup, name=F.concat(space, F.lit("."), base)))
    return out.unionByName(rows(s, sfile, "call", sup, owner=own, member=F.lit("go"), name=F.lit("trade"), receiver=own))


QUERIES = {
    "saved_answers": lambda spark, d: N.saved(answers(spark, d)).select("name", F.md5("text").alias("digest")),
    "memory_scan": reread,
    "known_citations": citations,
    "learning_overlay": lambda spark, d: marked(spark, d)[1].select("id", "bucket", "verdict", F.round("score", 6).alias("score"), "label", "fingerprint"),
    "overlay_staleness": staleness,
    "overlay_on_nodes": on_nodes,
    "url_policy": on("pages", urls),
    "clean_metadata": on("documents", metadata),
    "clean_texts": on("documents", lambda t: t.select("doc_id", F.md5(Y.clean_text(F.coalesce("text", F.lit("")))).alias("digest"))),
    "text_signs": on("documents", signs),
    "edges_between": on_graph(lambda g: K.edges_between(g.edges, "nation:3", "region:1").select("src", "tgt", "relation")),
    "language_bindings": lambda spark, d: L.resolve(scope_rows(spark, d)),
    "ask_with_hints": on_graph(lambda g: K.ask(g, "which module calls customer 000000012", depth=1, ascii_labels=True)),
}

_ANSWERS = """
a AS (SELECT doc, strftime(make_timestamp((1704067200 + doc) * 1000000), '%Y%m%d_%H%M%S') AS stamp, strftime(make_timestamp((1704067200 + doc) * 1000000), '%Y-%m-%dT%H:%M:%S') || 'Z' AS made, question || ' "' || chr(9) || '\\ of ' || doc AS question, question || ' \\"\\t\\\\ of ' || doc AS escaped,
  'answer ' || doc AS answer, CASE WHEN doc % 5 <> 0 THEN outcome END AS outcome, CASE WHEN outcome = 'corrected' THEN 'see ' || question END AS fix, CASE WHEN doc % 4 <> 0 THEN [a, b] ELSE [] END AS nodes FROM docs),
named AS (SELECT *, 'query_' || stamp || '_' || regexp_replace(regexp_replace(substr(lower(question), 1, 50), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') || '.md' AS name FROM a)"""
_BUCKET = "CASE WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' WHEN pos > 0 THEN 'tentative' END"
_MARKED = f"""
marked AS (SELECT id, bucket, CASE WHEN bucket = 'contested' THEN CASE WHEN score > 0 THEN 'useful' WHEN score < 0 THEN 'dead end' ELSE 'even' END END AS verdict, score, label, source_file FROM (SELECT node, score, {_BUCKET} AS bucket FROM scored) s JOIN nodes ON id = node WHERE bucket IS NOT NULL)"""
_STALE = "source_file LIKE '%/n3/%' OR source_file LIKE '%/n4/%'"
_PROBLEMS = "['scheme', 'address', 'address', 'address', 'metadata', 'address', NULL, 'host']"
_URL_LIST = "[" + ", ".join(f"'{u}'" for u in _URLS) + "]"
_SUP = "supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0"

ORACLES = {
    "saved_answers": f"""WITH {DOCS}, {_ANSWERS}
      SELECT name, md5('---' || chr(10) || 'type: "query"' || chr(10) || 'date: "' || made || '"' || chr(10) || 'question: "' || escaped || '"' || chr(10) || 'contributor: "tessera"' || chr(10) || coalesce('outcome: "' || outcome || '"' || chr(10), '') || coalesce('correction: "' || fix || '"' || chr(10), '')
        || CASE WHEN len(nodes) > 0 THEN 'source_nodes: ["' || nodes[1] || '", "' || nodes[2] || '"]' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || '# Q: ' || question || chr(10) || chr(10) || '## Answer' || chr(10) || chr(10) || answer
        || CASE WHEN outcome IS NOT NULL OR fix IS NOT NULL THEN chr(10) || chr(10) || '## Outcome' || chr(10) || coalesce(chr(10) || '- Signal: ' || outcome, '') || coalesce(chr(10) || '- Correction: ' || fix, '') ELSE '' END
        || CASE WHEN len(nodes) > 0 THEN chr(10) || chr(10) || '## Source Nodes' || chr(10) || chr(10) || '- ' || nodes[1] || chr(10) || '- ' || nodes[2] ELSE '' END) AS digest FROM named""",
    "memory_scan": f"WITH {DOCS}, {_ANSWERS} SELECT name AS path, question, outcome, coalesce(fix, '') AS correction, array_to_string(nodes, ',') AS nodes, made AS date FROM named",
    "known_citations": graph("SELECT doc, concat_ws(',', CASE WHEN a IN (SELECT id FROM nodes) THEN a END, CASE WHEN b IN (SELECT id FROM nodes) THEN b END) AS nodes FROM docs", DOCS),
    "learning_overlay": graph("SELECT id, bucket, verdict, round(score, 6) AS score, label, md5(source_file) AS fingerprint FROM marked", DOCS, _MARKED),
    "overlay_staleness": graph(f"SELECT id, bucket, source_file, {_STALE} AS stale FROM marked", DOCS, _MARKED),
    "overlay_on_nodes": graph(f"SELECT n.id, n.label, bucket, CASE WHEN m.id IS NOT NULL THEN m.{_STALE.replace('OR source_file', 'OR m.source_file')} END AS stale FROM nodes n LEFT JOIN marked m ON n.id = m.id", DOCS, _MARKED),
    "url_policy": f"SELECT page_id, CASE WHEN page_id % 16 < {len(_URLS)} THEN {_URL_LIST}[page_id % 16 + 1] ELSE 'https://example.com/' || page_id END AS url, CASE WHEN page_id % 16 < {len(_URLS)} THEN {_PROBLEMS}[page_id % 16 + 1] END AS problem FROM pages",
    "clean_metadata": "SELECT doc_id, '{' || coalesce('\"x\":\"&lt;a&gt;' || lang || '\",', '') || '\"y\":[' || array_to_string([('\"&amp;\"') FOR i IN range(50)], ',') || '],\"m\":{\"k\":\"' || repeat('z', 512) || '\"}}' AS meta FROM documents",
    "clean_texts": "SELECT doc_id, md5(substr(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), 1, 512)) AS digest FROM documents",
    "text_signs": "SELECT doc_id, 'get_' || lang || CASE WHEN strlen('of' || doc_id) >= 3 THEN ',of' || doc_id ELSE '' END AS names, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS n, doc_id % 3 <> 1 AS credentials, doc_id % 2 = 0 AS jwt, 'a_' || lang AS id FROM documents WHERE lang IS NOT NULL",
    "edges_between": graph("SELECT src, tgt, relation FROM edges WHERE (src = 'nation:3' AND tgt = 'region:1') OR (src = 'region:1' AND tgt = 'nation:3')"),
    "language_bindings": f"SELECT 's' || s_suppkey || '.java#Sup' || s_suppkey AS src, 'n' || n_nationkey || '.java#Nation' || n_nationkey AS tgt, 'inherits' AS relation FROM {_SUP} UNION ALL SELECT 's' || s_suppkey || '.java#Sup' || s_suppkey || '.go', 'n' || n_nationkey || '.java#Nation' || n_nationkey || '.trade', 'calls' FROM {_SUP}",
}
