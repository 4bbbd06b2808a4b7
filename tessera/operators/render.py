"""Texts for readers: pages as rows, so that a writer can store them in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import PropertyGraph, cut
from tessera.operators.export import xml_text
from tessera.operators.measures import cohesion, confidences, degrees, god_nodes, hub_labels, known_edges
from tessera.operators.traverse import induced_edges, tree_paths

#: Links of a node or members of a community that a page lists.
LISTED = 25


def plain(c: Column, most: int = 256) -> Column:
    """FLT15: without control characters, cut to so many characters."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), 1, most)


def subgraph_lines(g: PropertyGraph, visited: DataFrame) -> DataFrame:
    """GR10: (place, line) of a subgraph's text: seeds first, then by distance, degree and id, then the edges.

    visited: id, hop.  The places are those of one text, which a budget cuts; the ranking is of what
    was visited, not of the graph.
    """
    n = visited.join(g.nodes.select("id", "label", "source_file"), "id").join(degrees(g), "id")
    nodes = n.select(F.lit(0).alias("part"), "hop", (-F.col("degree")).alias("d"), F.col("id").alias("key"), F.concat(F.lit("NODE "), plain(F.col("label")), F.lit(" ["), "source_file", F.lit("]")).alias("line"))
    e = induced_edges(g, visited)
    edges = e.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("hop"), F.lit(0).cast("long").alias("d"), F.concat("a", F.lit(" "), "b").alias("key"), F.concat(F.lit("EDGE "), "a", F.lit(" --"), "relations", F.lit("-- "), "b").alias("line"))
    order = Window.orderBy("part", "hop", "d", "key")
    return nodes.unionByName(edges).withColumn("place", F.row_number().over(order).cast("long")).select("place", "line")


def tree_lines(g: PropertyGraph) -> DataFrame:
    """SNK7: (path, line): the ownership tree, each label indented by its depth; sort by path."""
    return tree_paths(g).select("path", F.concat(F.expr("repeat('  ', cast(depth as int))"), F.lit("- "), F.element_at(F.split("path", " / "), -1)).alias("line"))


def node_pages(g: PropertyGraph, links: int = LISTED) -> DataFrame:
    """SNK13: (id, page): a Markdown note for each node with its best links, by degree, then name.

    Each node's links are gathered in parts that keep the best only, so that hubs stay small.
    """
    e = known_edges(g).where("src <> tgt").select("src", "tgt", "relation")
    both = e.select(F.col("src").alias("id"), F.lit("to").alias("way"), F.col("tgt").alias("other"), "relation").unionByName(e.select(F.col("tgt").alias("id"), F.lit("from").alias("way"), F.col("src").alias("other"), "relation"))
    d = degrees(g).withColumnsRenamed({"id": "other", "degree": "d"})
    label = g.nodes.select(F.col("id").alias("other"), F.col("label").alias("name"))
    rows = both.join(d, "other").join(label, "other").withColumn("entry", F.struct((-F.col("d")).alias("k"), "other", "way", "relation", "name"))
    best = lambda c: F.slice(F.sort_array(F.collect_list(c)), 1, links)
    parts = rows.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(64))).groupBy("id", "part").agg(best("entry").alias("some"))
    top = parts.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, links).alias("links"))
    lines = F.array_join(F.transform("links", lambda x: F.concat(F.lit("- "), x["relation"], F.lit(" "), x["way"], F.lit(" [["), x["name"], F.lit("]]"))), "\n")
    n = g.nodes.join(top, "id", "left")
    return n.select("id", F.concat(F.lit("# "), plain(F.col("label")), F.lit("\n\nFile: "), "source_file", F.lit("\n\n"), F.coalesce(lines, F.lit("No links.")), F.lit("\n")).alias("page"))


def community_pages(g: PropertyGraph) -> DataFrame:
    """SNK12: (community, page): an article a community with its hub, size, cohesion and first members."""
    first = g.nodes.where("community is not null").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("node_ord"))).where(F.col("r") <= LISTED)
    names = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: F.concat(F.lit("- "), x["label"])), "\n").alias("names"))
    c = hub_labels(g).withColumnRenamed("label", "hub_label").join(cohesion(g), "community").join(names, "community")
    return c.select("community", F.concat(F.lit("# "), "hub_label", F.lit("\n\n"), F.col("size").cast("string"), F.lit(" members, cohesion "), F.col("cohesion").cast("string"), F.lit("\n\n"), "names", F.lit("\n")).alias("page"))


def html_page(g: PropertyGraph, top: int = 200) -> str:
    """SNK9: one HTML page of the best connected nodes and the edges between them."""
    best = cut(god_nodes(g, top).select("id", "label", "degree"))
    rows = best.select(F.concat(F.lit("<li id='"), xml_text(F.col("id")), F.lit("'>"), xml_text(F.col("label")), F.lit(" ("), F.col("degree").cast("string"), F.lit(")</li>")).alias("x"))
    edges = induced_edges(g, best).select(F.concat(F.lit("<li>"), xml_text(F.col("a")), F.lit(" - "), xml_text(F.col("b")), F.lit(": "), xml_text(F.col("relations")), F.lit("</li>")).alias("x"))
    text = lambda d: "\n".join(sorted(r.x for r in d.collect()))
    return f"<!doctype html><meta charset='utf-8'><title>Graph</title><h1>Nodes</h1><ul>\n{text(rows)}\n</ul><h1>Edges</h1><ul>\n{text(edges)}\n</ul>\n"


def report(g: PropertyGraph, isolated_nodes: DataFrame, surprises: DataFrame, asked: DataFrame) -> str:
    """SNK8: a report of summary, hubs, surprises, communities and questions, from small tables."""
    counts = g.nodes.agg(F.count("*").alias("n"), F.count_distinct("community").alias("c")).first()
    out = ["# Graph report", "", f"{counts.n} nodes, {g.edges.count()} edges, {counts.c} communities", "", "## Confidence"]
    out += [f"- {r.confidence}: {r.n} ({r.percent}%)" for r in confidences(g).orderBy("confidence").collect()]
    out += ["", "## Best connected"] + [f"- {r.label} ({r.degree})" for r in god_nodes(g).collect()]
    out += ["", "## Surprising connections"] + [f"- {r.src} {r.relation} {r.tgt} ({r.score})" for r in surprises.collect()]
    out += ["", "## Communities"] + [f"- {r.community}: {r.label}" for r in hub_labels(g).orderBy("community").limit(50).collect()]
    out += ["", f"## Weakly linked\n{isolated_nodes.count()} nodes", "", "## Questions"] + [f"- {r.question}" for r in asked.collect()]
    return "\n".join(out) + "\n"


def lessons(scored: DataFrame) -> str:
    """SNK17: lessons by bucket, best first."""
    out = ["# Lessons"]
    for bucket in ("preferred", "tentative", "contested"):
        rows = scored.where(F.col("bucket") == bucket).orderBy(F.desc("score"), "node").limit(100).collect()
        out += ["", f"## {bucket.capitalize()}"] + [f"- {r.node}: {r.score:g}" + (f" ({r.verdict})" if r.verdict else "") for r in rows]
    return "\n".join(out) + "\n"
