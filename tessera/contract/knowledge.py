"""Analysis, entity resolution and building."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.contract.measures import DIRTY, _CONCEPT, _FILE, dirty, on_graph
from tessera.contract.star_sql import graph
from tessera.model import CONFIDENCE_SCORE, FILE_TYPES, cut
from tessera.operators import analysis as A
from tessera.operators import build as B
from tessera.operators import entities as N
from tessera.sources.star import table

SECTIONS = {"sales": ["customer", "sales", "n1"], "supply": ["supplier", "supply", "rs"], "catalog": ["catalog", "brand", "document"]}


def things(g):
    """Nodes that labels may merge: parts and regions."""
    return cut(N.labels(g.nodes.where("file_type <> 'code'")))


def merged_parts(g):
    n = things(g)
    return N.winners(n, N.components(N.exact_pairs(n).unionByName(N.fuzzy_pairs(n))))


def odd_ends(g):
    """Ends as sloppy producers spell them."""
    e = g.edges.select(F.col("src").alias("value"))
    return e.unionByName(g.edges.select(F.when(F.col("relation") == "uses", F.upper(F.replace(F.col("tgt"), F.lit(":"), F.lit("-")))).when(F.col("relation") == "calls", F.concat(F.lit("old_"), "tgt")).otherwise(F.concat("tgt", F.lit("?x"))).alias("value"))).distinct()


def aliases(g):
    return g.nodes.where("id like 'supplier:%' and id not like '%7'").select(F.concat(F.lit("old_"), "id").alias("alias"), "id")


def repaired(g):
    return B.repair_ends(odd_ends(g), g.nodes, aliases=aliases(g), ascii_ids=True)


def fates(g):
    e = dirty(g).withColumn("relation", F.when(F.col("src") == F.col("tgt"), "imports").otherwise(F.col("relation")))
    ends = e.select(F.col("src").alias("value")).union(e.select("tgt")).distinct()
    return cut(B.edge_fates(e, B.repair_ends(ends, g.nodes, ascii_ids=True)))


def faulty(g):
    n = g.nodes.withColumn("file_type", F.when(F.endswith("id", F.lit("9")), "widget").otherwise(F.col("file_type"))).withColumn("label", F.when(F.endswith("id", F.lit("33")), None).otherwise(F.col("label")))
    e = g.edges.withColumn("confidence", F.when(F.endswith("tgt", F.lit("11")), "SURE").otherwise(F.col("confidence"))).withColumn("tgt", F.when(F.endswith("tgt", F.lit("13")), F.lit("nobody")).otherwise(F.col("tgt")))
    return B.violations(n, e, FILE_TYPES, tuple(CONFIDENCE_SCORE)).groupBy("kind", "problem").agg(F.count("*").alias("n"))


def weights(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 5 == 1, "-3").when(F.col("event_id") % 5 == 2, "abc").otherwise(F.col("value").cast("string"))
    return B.weights(e.select("event_id", raw.alias("weight"))).select("event_id", F.round("weight", 6).alias("weight"))


def hyper(g):
    """Hyperedges of the nodes of a community, by sloppy names, with repeats."""
    n = g.nodes.where("community < 5 and id like 'supplier:%'")
    h = n.groupBy(F.concat(F.lit("h"), F.col("community").cast("string")).alias("id")).agg(F.sort_array(F.collect_list(F.upper(F.replace(F.col("id"), F.lit(":"), F.lit("_"))))).alias("nodes"))
    h = h.withColumn("nodes", F.concat("nodes", F.slice("nodes", 1, 1), F.array(F.lit("nobody"))))
    values = h.select(F.explode("nodes").alias("value")).distinct()
    return B.hyperedge_members(h, B.repair_ends(values, g.nodes, ascii_ids=True))


def collisions(g):
    base = g.nodes.select("id", "label", "source_file")
    twice = base.where("id like 'customer:%5' or id like 'part:%5'").select("id", F.concat("label", F.lit("!")).alias("label"), F.concat(F.lit("x/"), "source_file").alias("source_file"))
    return N.collision_survivors(base.unionByName(twice))


def twin_nodes(g):
    n = g.nodes.select("id", "label", "source_file").withColumn("origin", F.lit("ast"))
    doc = n.where("id like 'part:%3'").select(F.concat("id", F.lit("_doc")).alias("id"), "label", "source_file", F.lit("semantic").alias("origin"))
    ghost = n.where("id like 'supplier:%'").select(F.concat(F.lit("g:"), "id").alias("id"), "label", "source_file", F.lit("semantic").alias("origin"))
    return n.unionByName(doc).unionByName(ghost)


QUERIES = {
    "surprising_cross_file": on_graph(lambda g: A.surprising(g, 50)),
    "surprise_scores": on_graph(lambda g: A.cross_file(g).groupBy("relation", "score").agg(F.count("*").alias("n"))),
    "surprising_cross_community": on_graph(A.surprising_communities),
    "suggested_questions": on_graph(A.questions),
    "file_categories": on_graph(lambda g: g.nodes.groupBy(A.file_category(F.col("source_file")).alias("category"), A.language_family(F.col("source_file")).alias("family"), A.top_dir(F.col("source_file")).alias("dir")).agg(F.count("*").alias("n"))),
    "architecture_sections": on_graph(lambda g: A.sections(g, SECTIONS)),
    "label_entropy": on_graph(lambda g: things(g).select("id", "norm", F.round("entropy", 6).alias("entropy"))),
    "shingle_jaccard_pairs": on_graph(lambda g: N.shingle_pairs(cut(N.first_of_label(things(g))), 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))),
    "jaro_pairs": on_graph(lambda g: jaro(cut(N.first_of_label(things(g))))),
    "exact_label_merge": on_graph(lambda g: N.exact_pairs(things(g))),
    "fuzzy_merge_pairs": on_graph(lambda g: N.fuzzy_pairs(things(g))),
    "dedup_components": on_graph(lambda g: N.components(N.exact_pairs(things(g)))),
    "dedup_winners": on_graph(lambda g: merged_parts(g)),
    "edge_rewire": on_graph(lambda g: N.rewire(g.edges, cut(N.winners(things(g), N.components(N.exact_pairs(things(g))))))),
    "id_collision_survivor": on_graph(collisions),
    "shortest_unique_suffix": on_graph(lambda g: N.unique_suffixes(g.nodes.select(F.col("source_file").alias("path")))),
    "endpoint_repair_tiers": on_graph(repaired),
    "edge_drop_reasons": on_graph(lambda g: B.drop_reasons(fates(g))),
    "edge_conservation": on_graph(lambda g: B.conservation(fates(g))),
    "weight_normalization": weights,
    "hyperedge_resolution": on_graph(hyper),
    "validation_findings": on_graph(faulty),
    "document_twins": on_graph(lambda g: B.twins(twin_nodes(g))),
    "ghost_nodes": on_graph(lambda g: B.ghosts(twin_nodes(g))),
    "normalize_id": on_graph(lambda g: g.nodes.select("id", B.normalize_id_udf("label").alias("slug"))),
}


def jaro(n):
    from tessera.functions.text import jaro_udf, jaro_winkler_udf

    p = N.shingle_pairs(n, 0.5).join(n.select(F.col("id").alias("a"), F.col("norm").alias("x")), "a").join(n.select(F.col("id").alias("b"), F.col("norm").alias("y")), "b")
    return p.select("a", "b", F.round(jaro_udf("x", "y"), 6).alias("jaro"), F.round(jaro_winkler_udf("x", "y"), 6).alias("jaro_winkler"))


_THINGS = """
things AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm FROM nodes WHERE file_type <> 'code'),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY node_ord) AS r FROM things) q WHERE r = 1),
grams AS (SELECT DISTINCT id, substr(t, i, 3) AS gram FROM (SELECT id, replace(norm, ' ', '') AS t, unnest(range(1, length(replace(norm, ' ', '')) - 1)) AS i FROM first) q),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) * 1.0 / (any_value(s.n) + any_value(t.n) - count(*)) AS jaccard FROM grams x JOIN grams y ON x.gram = y.gram AND x.id < y.id JOIN sizes s ON s.id = x.id JOIN sizes t ON t.id = y.id GROUP BY x.id, y.id)"""
_ENTROPY = """
ent AS (SELECT norm, sum(-p * log2(p)) AS entropy FROM (SELECT norm, count(*) * 1.0 / length(norm) AS p FROM (SELECT norm, unnest(string_split(norm, '')) AS c FROM (SELECT DISTINCT norm FROM things) d) u GROUP BY norm, c) q GROUP BY norm)"""
_ENDS = f"""
n AS (SELECT nodes.id, label, source_file AS file, community, degree FROM nodes JOIN degrees ON nodes.id = degrees.id),
cat AS (SELECT *, CASE WHEN file LIKE '%.py' OR file LIKE '%.rs' THEN 'code' ELSE 'doc' END AS cat, CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.rs' THEN 'rust' END AS fam,
   NOT {_CONCEPT.replace('source_file', 'file')} AND NOT {_FILE.replace('source_file', 'file')} AS plain FROM n),
ends AS (SELECT e.src, e.tgt, e.relation, e.confidence, s.label, s.file AS sf, t.file AS tf, s.community AS sc, t.community AS tc, s.plain AND t.plain AS plain, s.label AS sl, t.label AS tl,
   (confidence = 'INFERRED' AND relation IN ('calls', 'uses') AND (coalesce(s.fam <> t.fam, false) OR s.cat <> t.cat)) AS muted,
   CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN s.cat <> t.cat THEN 2 ELSE 0 END + CASE WHEN split_part(s.file, '/', 1) <> split_part(t.file, '/', 1) THEN 2 ELSE 0 END + CASE WHEN s.community <> t.community THEN 1 ELSE 0 END AS base,
   CASE WHEN least(s.degree, t.degree) <= 2 AND greatest(s.degree, t.degree) >= 5 THEN 1 ELSE 0 END AS hub
  FROM edges e JOIN cat s ON e.src = s.id JOIN cat t ON e.tgt = t.id),
scored AS (SELECT src, tgt, relation, label, CAST(CASE WHEN muted THEN 0 ELSE base END + hub AS BIGINT) AS score FROM ends WHERE relation NOT IN ('imports', 'imports_from', 'contains', 'method') AND sf <> tf AND plain)"""
_DEGREES_ENDS = _ENDS.replace("ends AS", "both_ends AS").replace("FROM ends WHERE", "FROM both_ends WHERE")
_EXACT = "exact AS (SELECT DISTINCT first_value(id) OVER (PARTITION BY norm, source_file ORDER BY node_ord) AS a, id AS b FROM things), pairs2 AS (SELECT a, b FROM exact WHERE a <> b)"
#: Exact pairs are stars around the first node, so their component is the star.
_ROOTS = "roots AS (SELECT id, root FROM (SELECT id, min(id) OVER (PARTITION BY norm, source_file) AS root, count(*) OVER (PARTITION BY norm, source_file) AS k FROM things) q WHERE k > 1), best AS (SELECT id, first_value(id) OVER (PARTITION BY norm, source_file ORDER BY length(id), node_ord) AS winner, count(*) OVER (PARTITION BY norm, source_file) AS k FROM things)"
_ODD = """
vals AS (SELECT src AS value FROM edges UNION SELECT CASE relation WHEN 'uses' THEN upper(replace(tgt, ':', '-')) WHEN 'calls' THEN 'old_' || tgt ELSE tgt || '?x' END FROM edges),
keyed AS (SELECT value, trim(regexp_replace(lower(value), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM vals),
norm AS (SELECT replace(id, ':', '_') AS key, id FROM nodes),
old AS (SELECT 'old_' || replace(id, ':', '_') AS key, id FROM nodes WHERE id LIKE 'supplier:%' AND id NOT LIKE '%7')"""
_FATES = """
fates AS (SELECT src, tgt, CASE WHEN src = tgt THEN 'imports' ELSE relation END AS relation,
   CASE WHEN src NOT IN (SELECT id FROM nodes) OR tgt NOT IN (SELECT id FROM nodes) THEN 'unresolved_endpoint' WHEN src = tgt THEN 'import_self_loop' END AS reason FROM dirty)"""

ORACLES = {
    "surprising_cross_file": graph("SELECT src, tgt, relation, score FROM scored ORDER BY score DESC, label, src, tgt LIMIT 50", _DEGREES_ENDS, degrees=True),
    "surprise_scores": graph("SELECT relation, score, count(*) AS n FROM scored GROUP BY relation, score", _DEGREES_ENDS, degrees=True),
    "surprising_cross_community": graph(
        """SELECT a, b, src, tgt, relation, confidence FROM (SELECT least(s.community, t.community) AS a, greatest(s.community, t.community) AS b, src, tgt, relation, confidence,
             row_number() OVER (PARTITION BY least(s.community, t.community), greatest(s.community, t.community) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, src, tgt, relation) AS r
           FROM edges JOIN nodes s ON src = s.id JOIN nodes t ON tgt = t.id WHERE s.community <> t.community AND relation <> 'contains') q WHERE r = 1"""
    ),
    "suggested_questions": graph(
        """SELECT kind, question FROM (SELECT 'ambiguous_edge' AS kind, 'What is the exact relationship between `' || s.label || '` and `' || t.label || '`?' AS question, row_number() OVER (ORDER BY src, tgt, relation) AS r
           FROM edges JOIN nodes s ON src = s.id JOIN nodes t ON tgt = t.id WHERE confidence = 'AMBIGUOUS') q WHERE r <= 10"""
    ),
    "file_categories": graph(
        "SELECT CASE WHEN source_file LIKE '%.py' OR source_file LIKE '%.rs' THEN 'code' ELSE 'doc' END AS category, CASE WHEN source_file LIKE '%.py' THEN 'python' WHEN source_file LIKE '%.rs' THEN 'rust' END AS family, split_part(source_file, '/', 1) AS dir, count(*) AS n FROM nodes GROUP BY 1, 2, 3"
    ),
    "architecture_sections": graph(
        f"""SELECT c.community, CASE WHEN b.hits >= 2 THEN b.section ELSE 'other' END AS section, coalesce(b.hits, 0) AS hits FROM (SELECT DISTINCT community FROM nodes WHERE community IS NOT NULL) c
           LEFT JOIN (SELECT * FROM (SELECT community, section, count(*) AS hits, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, min(place) DESC) AS r
             FROM (SELECT community, unnest(string_split_regex(lower(label || ' ' || source_file || ' ' || file_type), '[^a-z0-9]+')) AS word FROM nodes WHERE community IS NOT NULL) w
             JOIN (VALUES {", ".join(f"({i}, '{s}', '{k}')" for i, (s, ks) in enumerate(SECTIONS.items()) for k in ks)}) v(place, section, kw) ON w.word = v.kw GROUP BY community, section) q WHERE r = 1) b ON c.community = b.community"""
    ),
    "label_entropy": graph("SELECT id, norm, round(CAST(coalesce(entropy, 0) AS DOUBLE), 6) AS entropy FROM things LEFT JOIN ent USING (norm)", _THINGS, _ENTROPY),
    "shingle_jaccard_pairs": graph("SELECT a, b, round(CAST(jaccard AS DOUBLE), 6) AS jaccard FROM pairs WHERE jaccard >= 0.5", _THINGS),
    "jaro_pairs": graph("SELECT a, b, round(jaro_similarity(x.norm, y.norm), 6) AS jaro, round(jaro_winkler_similarity(x.norm, y.norm), 6) AS jaro_winkler FROM pairs JOIN first x ON x.id = a JOIN first y ON y.id = b WHERE jaccard >= 0.5", _THINGS),
    "exact_label_merge": graph("SELECT a, b FROM pairs2", _THINGS, _EXACT),
    "dedup_components": graph("SELECT id, root FROM roots", _THINGS, _ROOTS),
    "edge_rewire": graph(
        "SELECT DISTINCT coalesce(s.winner, src) AS src, coalesce(t.winner, tgt) AS tgt, relation FROM edges LEFT JOIN best s ON s.id = src LEFT JOIN best t ON t.id = tgt WHERE coalesce(s.winner, src) <> coalesce(t.winner, tgt)", _THINGS, _ROOTS
    ),
    "id_collision_survivor": graph(
        "SELECT id, label, source_file, CASE WHEN id LIKE 'customer:%5' OR id LIKE 'part:%5' THEN CAST(2 AS BIGINT) ELSE 1 END AS n FROM nodes"
    ),
    "shortest_unique_suffix": graph(
        """SELECT path, suffix FROM (SELECT path, suffix, row_number() OVER (PARTITION BY path ORDER BY length(suffix)) AS r FROM (SELECT suffix, min(path) AS path FROM
             (SELECT path, array_to_string(string_split(path, '/')[-k:], '/') AS suffix FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM (SELECT DISTINCT source_file AS path FROM nodes) f) g) s GROUP BY suffix HAVING count(*) = 1) u) q WHERE r = 1"""
    ),
    "endpoint_repair_tiers": graph(
        """SELECT k.value, coalesce(e.id, m.id, o.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN m.id IS NOT NULL THEN 'normalized' WHEN o.id IS NOT NULL THEN 'legacy' ELSE 'unresolved' END AS tier
           FROM keyed k LEFT JOIN nodes e ON k.value = e.id LEFT JOIN norm m ON k.key = m.key LEFT JOIN old o ON k.key = o.key""",
        _ODD,
    ),
    "edge_drop_reasons": graph(
        "SELECT reason, count(*) AS n FROM fates WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'duplicate_key', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM fates WHERE reason IS NULL GROUP BY src, tgt, relation) q", DIRTY, _FATES
    ),
    "edge_conservation": graph(
        """SELECT input, output, input - output AS dropped, true AS accounted FROM (SELECT (SELECT count(*) FROM dirty) AS input, (SELECT count(*) FROM (SELECT DISTINCT src, tgt, relation FROM fates WHERE reason IS NULL) d) AS output) q""", DIRTY, _FATES
    ),
    "weight_normalization": "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN CAST(1.0 AS DOUBLE) WHEN value >= 0 THEN round(value, 6) ELSE 1.0 END AS weight FROM events",
    "hyperedge_resolution": graph(
        "SELECT 'h' || community AS id, row_number() OVER (PARTITION BY community ORDER BY upper(replace(id, ':', '_'))) - 1 AS place, id AS member FROM nodes WHERE community < 5 AND id LIKE 'supplier:%'"
    ),
    "validation_findings": graph(
        """SELECT 'node' AS kind, 'missing label' AS problem, count(*) AS n FROM nodes WHERE id LIKE '%33' HAVING count(*) > 0
           UNION ALL SELECT 'node', 'invalid file_type widget', count(*) FROM nodes WHERE id LIKE '%9'
           UNION ALL SELECT 'edge', 'invalid confidence SURE', count(*) FROM edges WHERE tgt LIKE '%11'
           UNION ALL SELECT 'edge', 'unknown tgt nobody', count(*) FROM edges WHERE tgt LIKE '%13'"""
    ),
    "document_twins": graph("SELECT id, id || '_doc' AS to FROM nodes WHERE id LIKE 'part:%3'").replace("AS to", 'AS "to"'),
    "ghost_nodes": graph(
        """SELECT g.id, s.id AS "to" FROM (SELECT id || '_doc' AS id, label, source_file FROM nodes WHERE id LIKE 'part:%3' UNION ALL SELECT 'g:' || id, label, source_file FROM nodes WHERE id LIKE 'supplier:%') g
           JOIN (SELECT source_file, label, min(id) AS id FROM nodes GROUP BY source_file, label HAVING count(*) = 1) s ON g.source_file = s.source_file AND g.label = s.label"""
    ),
    "normalize_id": graph("SELECT id, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM nodes"),
}
