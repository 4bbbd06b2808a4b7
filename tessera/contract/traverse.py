"""Search and traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.contract.measures import on_graph
from tessera.contract.star_sql import graph
from tessera.functions.text import query_terms
from tessera.model import cut
from tessera.operators import search as S
from tessera.operators import traverse as T

QUESTION = "which supplier of nation_3 sells hot gear to customer 000000012"
TERMS = query_terms(QUESTION)
SEED = "nation:3"


def searched(f):
    return on_graph(lambda g: f(g, S.searchable(g, ascii_labels=True)))


def seeds(g):
    return S.pick_seeds(g, QUESTION, ascii_labels=True)


def trade(g):
    """Nations whose customers ordered the dearest parcels from suppliers of another nation."""
    calls = g.edges.where("relation = 'calls' and confidence = 'EXTRACTED'").select("src", "tgt")
    c = g.nodes.select("id", "community")
    e = calls.join(c.withColumnsRenamed({"id": "src", "community": "a"}), "src").join(c.withColumnsRenamed({"id": "tgt", "community": "b"}), "tgt")
    return e.groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 6").select(F.lpad(F.col("a").cast("string"), 2, "0").alias("a"), F.lpad(F.col("b").cast("string"), 2, "0").alias("b"))


QUERIES = {
    "query_terms_idf": searched(lambda g, n: S.term_weights(n, TERMS).withColumn("idf", F.round("idf", 6))),
    "score_nodes": searched(lambda g, n: S.score_nodes(n, TERMS).select("id", F.round("score", 6).alias("score"))),
    "best_seed_per_term": searched(lambda g, n: S.best_seed_per_term(g, n, TERMS)),
    "pick_seeds": on_graph(seeds),
    "find_node_tiers": searched(lambda g, n: S.find_nodes(n, "hot")),
    "trigram_postings": searched(lambda g, n: S.trigrams(n).groupBy("gram").agg(F.count("*").alias("n"))),
    "trigram_candidates": searched(lambda g, n: S.trigram_candidates(n, "0000012")),
    "bfs_depth2": on_graph(lambda g: T.bfs(g, g.nodes.where(F.col("id") == SEED).select("id"), 2)),
    "bfs_induced_edges": on_graph(lambda g: T.induced_edges(g, cut(T.bfs(g, g.nodes.where(F.col("id") == SEED).select("id"), 1)))),
    "question_subgraph": on_graph(lambda g: T.question_subgraph(g, QUESTION, 1, ascii_labels=True)),
    "affected_depth2": on_graph(lambda g: T.affected(g, "part:5", 2)),
    "shortest_path_hops": on_graph(lambda g: T.shortest_hops(g, "region:0", 4)),
    "shortest_path": on_graph(lambda g: T.shortest_path(g, "region:0", "part:5")),
    "neighbors": on_graph(lambda g: T.neighbours(g, SEED)),
    "explain_connections": on_graph(lambda g: T.explain(g, SEED)),
    "explain_grouped_overflow": on_graph(lambda g: T.explain_rest(g, SEED)),
    "import_cycles": on_graph(lambda g: T.cycles(trade(g), 3)),
    "tree_paths": on_graph(T.tree_paths),
    "hierarchy_distance": on_graph(T.hierarchy),
    "file_digraph": on_graph(lambda g: T.file_digraph(g, ("calls", "uses"))),
    "dfs_depth2": on_graph(lambda g: T.dfs(g, SEED, 2)),
}

_SEARCHABLE = """
s AS (SELECT id, label, node_ord, lower(label) AS norm, regexp_replace(lower(label), '(\\(\\))+$', '') AS bare, trim(regexp_replace(lower(label), '[^_\\p{L}\\p{N}]+', ' ', 'g')) AS tokens, lower(source_file) AS source, lower(id) AS low_id FROM nodes)"""
_VALUES = ", ".join(f"('{t}')" for t in TERMS)
_IDF = f"""
terms AS (SELECT * FROM (VALUES {_VALUES}) v(term)),
idf AS (SELECT term, (SELECT count(*) FROM s WHERE contains(norm, term)) AS df, ln(1 + (SELECT count(*) FROM s) / (1.0 + (SELECT count(*) FROM s WHERE contains(norm, term)))) AS w FROM terms)"""
_HITS = """
hits AS (SELECT s.id, s.label, term, w,
   CASE WHEN norm = term OR bare = term THEN 1000.0 * w WHEN starts_with(norm, term) OR starts_with(bare, term) THEN 100.0 * w ELSE 0 END AS tier,
   CASE WHEN norm = term OR bare = term OR starts_with(norm, term) OR starts_with(bare, term) THEN 0 WHEN contains(norm, term) THEN w ELSE 0 END AS inn,
   CASE WHEN contains(source, term) THEN 0.5 * w ELSE 0 END AS src_hit,
   CASE WHEN norm = term OR bare = term OR tokens = term OR low_id = term THEN 10000.0 * w WHEN starts_with(norm, term) OR starts_with(bare, term) OR starts_with(tokens, term) THEN 1000.0 * w ELSE 0 END AS alone
  FROM s CROSS JOIN idf)"""
_JOINED = " ".join(TERMS)
_SCORES = f"""
scores AS (SELECT s.id, s.label, s.norm,
    CASE WHEN s.norm = '{_JOINED}' OR s.bare = '{_JOINED}' OR s.tokens = '{_JOINED}' OR s.low_id = '{_JOINED}' THEN 10000.0 * greatest(1, (SELECT max(w) FROM idf))
         WHEN starts_with(s.norm, '{_JOINED}') OR starts_with(s.bare, '{_JOINED}') OR starts_with(s.tokens, '{_JOINED}') THEN 1000.0 * greatest(1, (SELECT max(w) FROM idf)) ELSE 0 END
    + h.loose + h.tiers * pow(h.matched / {len(TERMS)}.0, 2) AS score
  FROM s JOIN (SELECT id, sum(inn + src_hit) AS loose, sum(tier) AS tiers, sum(CASE WHEN tier > 0 OR inn > 0 THEN 1 ELSE 0 END) AS matched FROM hits GROUP BY id) h ON s.id = h.id)"""
_SINGLE = """
single AS (SELECT term, id, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, degree DESC, length(label), id) AS r
  FROM (SELECT h.term, h.id, h.label, alone + tier + inn + src_hit AS score, d.degree FROM hits h JOIN degrees d ON h.id = d.id) q WHERE score > 0)"""
_ADJ = "adj AS (SELECT src AS node, tgt AS other FROM known WHERE src <> tgt UNION SELECT tgt, src FROM known WHERE src <> tgt)"
_GATE = "gate AS (SELECT greatest(degree, 50) AS floor FROM (SELECT degree, row_number() OVER (ORDER BY degree) AS r, count(*) OVER () AS n FROM degrees) q WHERE r = n * 99 // 100 + 1)"


def _levels(seed: str, depth: int) -> str:
    """Tables l0, l1, ... of the nodes that are first reached at each depth behind the hub gate."""
    out = [f"l0 AS ({seed})"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(d))
        frontier = f"l{d - 1}" if d == 1 else f"(SELECT x.id FROM l{d - 1} x JOIN degrees g ON x.id = g.id WHERE g.degree < (SELECT floor FROM gate)) f"
        out.append(f"l{d} AS (SELECT DISTINCT other AS id FROM adj WHERE node IN (SELECT id FROM {frontier}) AND other NOT IN ({seen}))")
    return ", ".join(out)


_N1 = f"SELECT id FROM nodes WHERE id = '{SEED}'"
_NEIGH = f"neigh AS (SELECT d.direction, d.other, n.label, d.relation, d.confidence FROM (SELECT 'out' AS direction, tgt AS other, relation, confidence FROM known WHERE src = '{SEED}' UNION ALL SELECT 'in', src, relation, confidence FROM known WHERE tgt = '{SEED}') d JOIN nodes n ON n.id = d.other)"
_EXPLAIN = "ex AS (SELECT row_number() OVER (ORDER BY degree DESC, direction, other, relation) AS rank, direction, other, relation, degree FROM neigh JOIN degrees ON degrees.id = neigh.other)"
_INDUCED = "SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM edges WHERE src <> tgt AND src IN (SELECT id FROM v) AND tgt IN (SELECT id FROM v) GROUP BY 1, 2"
_TRADE = "trade AS (SELECT lpad(CAST(a.community AS VARCHAR), 2, '0') AS a, lpad(CAST(b.community AS VARCHAR), 2, '0') AS b FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON tgt = b.id WHERE relation = 'calls' AND confidence = 'EXTRACTED' GROUP BY 1, 2 HAVING count(*) >= 6)"
_SEEDS = f"""
firsts AS (SELECT id, norm, score, row_number() OVER (ORDER BY score DESC, length(label), id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, length(label), id) AS f FROM scores WHERE score > 0) q WHERE f = 1),
top AS (SELECT id, norm, r FROM firsts WHERE r <= 3 AND score >= 0.2 * (SELECT max(score) FROM firsts)),
own AS (SELECT term, id, norm, row_number() OVER (PARTITION BY norm ORDER BY term) AS k FROM (SELECT x.term, x.id, s.norm FROM single x JOIN s ON x.id = s.id WHERE x.r = 1) q WHERE norm NOT IN (SELECT norm FROM top)),
seeds AS (SELECT row_number() OVER (ORDER BY part, r, term) - 1 AS rank, id FROM (SELECT 0 AS part, r, '' AS term, id FROM top UNION ALL SELECT 1, 0, term, id FROM own WHERE k = 1) q)"""

ORACLES = {
    "query_terms_idf": graph("SELECT term, df, round(w, 6) AS idf FROM idf", _SEARCHABLE, _IDF),
    "score_nodes": graph("SELECT id, round(CAST(score AS DOUBLE), 6) AS score FROM scores WHERE score > 0", _SEARCHABLE, _IDF, _HITS, _SCORES),
    "best_seed_per_term": graph("SELECT term, id, round(CAST(score AS DOUBLE), 6) AS score FROM single WHERE r = 1", _SEARCHABLE, _IDF, _HITS, _SINGLE, degrees=True),
    "pick_seeds": graph("SELECT rank, id FROM seeds", _SEARCHABLE, _IDF, _HITS, _SCORES, _SINGLE, _SEEDS, degrees=True),
    "find_node_tiers": graph(
        "SELECT id, CAST(tier AS BIGINT) AS tier FROM (SELECT id, CASE WHEN source = 'hot' THEN 0 WHEN norm = 'hot' OR bare = 'hot' OR tokens = 'hot' OR low_id = 'hot' THEN 1 WHEN starts_with(norm, 'hot') OR starts_with(bare, 'hot') THEN 2 WHEN contains(norm, 'hot') THEN 3 END AS tier FROM s) q WHERE tier IS NOT NULL",
        _SEARCHABLE,
    ),
    "trigram_postings": graph("SELECT gram, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN length(norm) < 3 THEN norm ELSE substr(norm, i, 3) END AS gram FROM (SELECT id, norm, unnest(range(1, greatest(2, length(norm) - 1))) AS i FROM s) q) p GROUP BY gram", _SEARCHABLE),
    "trigram_candidates": graph("SELECT id FROM s WHERE " + " AND ".join(f"contains(norm, '{g}')" for g in sorted({"0000012"[i : i + 3] for i in range(5)})), _SEARCHABLE),
    "bfs_depth2": graph("SELECT id, 0 AS hop FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2", _ADJ, _GATE, _levels(_N1, 2), degrees=True).replace("SELECT id, 0 AS hop", "SELECT id, CAST(0 AS BIGINT) AS hop"),
    "bfs_induced_edges": graph(_INDUCED, _ADJ, _GATE, _levels(_N1, 1), "v AS (SELECT id FROM l0 UNION SELECT id FROM l1)", degrees=True),
    "question_subgraph": graph(
        f"SELECT 'node' AS kind, id AS src, CAST(NULL AS VARCHAR) AS tgt, CAST(NULL AS VARCHAR) AS relation, CAST(hop AS BIGINT) AS hop FROM (SELECT id, 0 AS hop FROM l0 UNION ALL SELECT id, 1 FROM l1) q UNION ALL SELECT 'edge', a, b, relations, NULL FROM ({_INDUCED}) i",
        _SEARCHABLE, _IDF, _HITS, _SCORES, _SINGLE, _SEEDS, _ADJ, _GATE, _levels("SELECT DISTINCT id FROM seeds", 1), "v AS (SELECT id FROM l0 UNION SELECT id FROM l1)", degrees=True,
    ),
    "affected_depth2": graph(
        "SELECT id, CAST(1 AS BIGINT) AS hop, via, relation FROM a1 UNION ALL SELECT id, 2, via, relation FROM a2",
        "back AS (SELECT src, tgt, relation FROM known WHERE relation IN ('calls', 'uses'))",
        "a0 AS (SELECT tgt AS id FROM known WHERE src = 'part:5' AND relation IN ('method', 'contains') UNION SELECT id FROM nodes WHERE id = 'part:5')",
        "a1 AS (SELECT src AS id, tgt AS via, relation FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY tgt, relation) AS r FROM back WHERE tgt IN (SELECT id FROM a0) AND src NOT IN (SELECT id FROM a0)) q WHERE r = 1)",
        "a2 AS (SELECT src AS id, tgt AS via, relation FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY tgt, relation) AS r FROM back WHERE tgt IN (SELECT id FROM a1) AND src NOT IN (SELECT id FROM a0 UNION ALL SELECT id FROM a1)) q WHERE r = 1)",
        degrees=True,
    ),
    "shortest_path_hops": graph(
        "SELECT id, CAST(0 AS BIGINT) AS hop FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3 UNION ALL SELECT id, 4 FROM l4",
        _ADJ, "gate AS (SELECT 1000000000 AS floor)", _levels("SELECT id FROM nodes WHERE id = 'region:0'", 4), degrees=True,
    ),
    "neighbors": graph("SELECT direction, other, label, relation, confidence FROM neigh", _NEIGH, degrees=True),
    "explain_connections": graph("SELECT rank, direction, other, relation, degree FROM ex WHERE rank <= 20", _NEIGH, _EXPLAIN, degrees=True),
    "explain_grouped_overflow": graph("SELECT direction, source_file, count(*) AS n FROM ex JOIN nodes ON nodes.id = ex.other WHERE rank > 20 GROUP BY direction, source_file", _NEIGH, _EXPLAIN, degrees=True),
    "import_cycles": graph(
        """SELECT CAST(1 AS BIGINT) AS length, a AS cycle FROM trade WHERE a = b
           UNION ALL SELECT 2, x.a || ' > ' || x.b FROM trade x JOIN trade y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b
           UNION ALL SELECT 3, x.a || ' > ' || x.b || ' > ' || y.b FROM trade x JOIN trade y ON x.b = y.a JOIN trade z ON y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b""",
        _TRADE,
    ),
    "tree_paths": graph(
        """SELECT CAST(0 AS BIGINT) AS depth, label AS path FROM nodes WHERE id LIKE 'region:%' AND id IN (SELECT src FROM edges WHERE relation = 'contains')
           UNION ALL SELECT 1, a.label || ' / ' || b.label FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.tgt = b.id WHERE relation = 'contains' AND e.src LIKE 'region:%'
           UNION ALL SELECT 2, a.label || ' / ' || b.label || ' / ' || c.label FROM edges e JOIN edges f ON e.tgt = f.src JOIN nodes a ON e.src = a.id JOIN nodes b ON e.tgt = b.id JOIN nodes c ON f.tgt = c.id WHERE e.relation = 'contains' AND f.relation = 'contains' AND e.src LIKE 'region:%'"""
    ),
    "hierarchy_distance": graph(
        "SELECT src AS owner, tgt AS id, CAST(1 AS BIGINT) AS distance FROM edges WHERE relation = 'contains' UNION ALL SELECT e.src, f.tgt, 2 FROM edges e JOIN edges f ON e.tgt = f.src WHERE e.relation = 'contains' AND f.relation = 'contains'"
    ),
    "file_digraph": graph("SELECT DISTINCT a.source_file AS a, b.source_file AS b FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON tgt = b.id WHERE relation IN ('calls', 'uses')"),
}
