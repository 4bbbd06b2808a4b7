"""Traversal: neighbourhoods behind a hub gate, induced edges, paths, reverse impact, cycles and trees.

A traversal is a loop of joins of a frontier with the adjacency; each level is written to the
checkpoint folder, so that lineage stays short and a lost executor costs no more than a level.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import PropertyGraph, cut
from tessera.operators.measures import degrees, hub_floor, known_edges
from tessera.operators.onetask import ROWS, Arcs, numbered, rows

# Relations along which a change is felt.
IMPACT = ("calls", "indirect_call", "references", "imports", "imports_from", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds", "requires")
OWNERSHIP = ("method", "contains")
#: Traversals go no deeper.
DEEPEST = 6


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other) of every edge both ways, once each, without loops."""
    both = edges.select(F.col("src").alias("node"), F.col("tgt").alias("other")).union(edges.select("tgt", "src"))
    return both.where("node <> other").distinct()


def bfs(g: PropertyGraph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """GR6, GR22: (id, hop) within depth of the seeds; hubs other than seeds are reached but not passed."""
    adj = cut(adjacency(known_edges(g)))
    return _levels(adj, _open_nodes(g), seeds.select("id").distinct().join(g.nodes.select("id"), "id", "left_semi"), min(depth, DEEPEST))


def _open_nodes(g: PropertyGraph) -> DataFrame:
    """(id) of all nodes but hubs."""
    of = cut(degrees(g))
    return of.where(F.col("degree") < hub_floor(of).first()[0]).select("id")


def _levels(adj: DataFrame, open_nodes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hop) within depth of the seeds over an adjacency; nodes that aren't open are reached but not passed."""
    seen = cut(seeds.select("id").withColumn("hop", F.lit(0).cast("long")))
    frontier = seen
    for hop in range(1, depth + 1):
        # A frontier is small against the edges; the optimizer broadcasts it by its size.
        step = frontier.join(adj, frontier.id == adj.node).select(F.col("other").alias("id")).distinct()
        fresh = cut(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop).cast("long")))
        seen = seen.unionByName(fresh)
        frontier = fresh.join(open_nodes, "id", "left_semi")
        if not fresh.limit(1).count():
            break
    return seen


def induced_edges(g: PropertyGraph, visited: DataFrame) -> DataFrame:
    """GR9, JN12: (a, b, relations) of each unordered pair inside the visited nodes."""
    v = visited.select("id")
    inside = g.edges.where("src <> tgt").join(v, g.edges.src == v.id, "left_semi").join(v, g.edges.tgt == v.id, "left_semi")
    return inside.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"))


def question_subgraph(g: PropertyGraph, question: str, depth: int = 2, ascii_labels: bool = False) -> DataFrame:
    """GR1: (kind, src, tgt, relation, hop): the nodes and edges near the nodes that a question means."""
    from tessera.operators.search import pick_seeds

    visited = cut(bfs(g, pick_seeds(g, question, ascii_labels=ascii_labels), depth))
    none = F.lit(None).cast("string")
    nodes = visited.select(F.lit("node").alias("kind"), F.col("id").alias("src"), none.alias("tgt"), none.alias("relation"), "hop")
    edges = induced_edges(g, visited).select(F.lit("edge").alias("kind"), F.col("a").alias("src"), F.col("b").alias("tgt"), F.col("relations").alias("relation"), F.lit(None).cast("long").alias("hop"))
    return nodes.unionByName(edges)


def shortest_hops(g: PropertyGraph, start: str, most: int = 8) -> DataFrame:
    """(id, hop): the undirected distance from a node, by levels."""
    adj = cut(adjacency(known_edges(g)))
    seen = cut(g.nodes.where(F.col("id") == start).select("id", F.lit(0).cast("long").alias("hop")))
    frontier = seen
    for hop in range(1, most + 1):
        step = frontier.join(adj, frontier.id == adj.node).select(F.col("other").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop).cast("long")))
        seen = seen.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    return seen


def shortest_path(g: PropertyGraph, start: str, end: str, most: int = 8) -> DataFrame:
    """GR14: (step, id) of one shortest path; among equals, the one whose nodes back from the end come first by distance and id."""
    hops = cut(shortest_hops(g, start, most))
    adj = cut(adjacency(known_edges(g)))
    spark = g.nodes.sparkSession
    found = hops.where(F.col("id") == end).collect()
    if not found:
        return spark.createDataFrame([], "step long, id string")
    path, at = [end], found[0].hop
    while at > 0:  # one row a hop
        near = adj.where(F.col("node") == path[-1]).join(hops.where(F.col("hop") == at - 1), F.col("other") == F.col("id"), "left_semi")
        path.append(near.agg(F.min("other")).first()[0])
        at -= 1
    return spark.createDataFrame(list(enumerate(reversed(path))), "step long, id string")


def affected(g: PropertyGraph, seed: str, depth: int = 2, relations: tuple[str, ...] = IMPACT) -> DataFrame:
    """GR17: (id, hop, via, relation) of nodes that a change of the seed reaches against the direction of edges.

    The seed's own members start with it and are not reported.  Each hit keeps the edge that reaches
    it first, in the order of (node reached from, relation).
    """
    e = cut(known_edges(g).select("src", "tgt", "relation"))
    own = e.where((F.col("src") == seed) & F.col("relation").isin(*OWNERSHIP)).select(F.col("tgt").alias("id"))
    seen = cut(own.union(g.nodes.where(F.col("id") == seed).select("id")).distinct())
    back = e.where(F.col("relation").isin(*relations)).select("src", "tgt", "relation")
    frontier, hits = seen, []
    for hop in range(1, depth + 1):
        step = frontier.join(back, frontier.id == back.tgt).groupBy("src").agg(F.min(F.struct("tgt", "relation")).alias("first"))
        fresh = step.join(seen.select(F.col("id").alias("src")), "src", "left_anti")
        fresh = cut(fresh.select(F.col("src").alias("id"), F.lit(hop).cast("long").alias("hop"), F.col("first.tgt").alias("via"), F.col("first.relation").alias("relation")))
        hits.append(fresh)
        seen, frontier = seen.union(fresh.select("id")), fresh.select("id")
        if not fresh.limit(1).count():
            break
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out


def neighbours(g: PropertyGraph, node: str) -> DataFrame:
    """GR20, TOP8: (direction, other, label, relation, confidence) of a node's edges."""
    e = known_edges(g)
    out = e.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("tgt").alias("other"), "relation", "confidence")
    back = e.where(F.col("tgt") == node).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "relation", "confidence")
    return out.unionByName(back).join(g.nodes.select(F.col("id").alias("other"), "label"), "other").select("direction", "other", "label", "relation", "confidence")


def explain(g: PropertyGraph, node: str, top: int = 20) -> DataFrame:
    """GR16, TOP9: (rank, direction, other, relation, degree): a node's best connected neighbours."""
    n = neighbours(g, node).join(degrees(g).withColumnRenamed("id", "other"), "other")
    best = n.orderBy(F.desc("degree"), "direction", "other", "relation").limit(top)
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "direction", "other", "relation")).cast("long")).select("rank", "direction", "other", "relation", "degree")


def explain_rest(g: PropertyGraph, node: str, top: int = 20) -> DataFrame:
    """AGG26: (direction, source_file, n): what explain leaves out, by file."""
    n = neighbours(g, node).select("direction", "other", "relation")
    rest = n.join(explain(g, node, top), ["direction", "other", "relation"], "left_anti")
    files = rest.join(g.nodes.select(F.col("id").alias("other"), "source_file"), "other")
    return files.groupBy("direction", "source_file").agg(F.count("*").alias("n"))


def file_digraph(g: PropertyGraph, relations: tuple[str, ...]) -> DataFrame:
    """AGG28: distinct (a, b) of files whose nodes are linked by the relations."""
    f = g.nodes.select("id", F.col("source_file").alias("file"))
    e = g.edges.where(F.col("relation").isin(*relations)).join(f.withColumnsRenamed({"id": "src", "file": "a"}), "src").join(f.withColumnsRenamed({"id": "tgt", "file": "b"}), "tgt")
    return e.where("a <> '' and b <> ''").select("a", "b").distinct()


def cycles(pairs: DataFrame, longest: int = 3) -> DataFrame:
    """GR23, GR24, TOP7: (length, cycle) of simple cycles, each from its smallest member on.

    A path starts at its smallest node and only goes to larger ones, so each cycle comes once.
    """
    pairs = pairs.distinct()
    out = pairs.where("a = b").select(F.lit(1).cast("long").alias("length"), F.col("a").alias("cycle"))
    step = pairs.where("a < b").select(F.col("a").alias("first"), F.col("b").alias("last"), F.array("a", "b").alias("path"))
    ends = pairs.where("b < a").select(F.col("a").alias("last"), F.col("b").alias("first"))
    for n in range(2, longest + 1):
        closed = step.join(ends, ["last", "first"]).select(F.lit(n).cast("long").alias("length"), F.array_join("path", " > ").alias("cycle"))
        out = out.unionByName(closed)
        if n < longest:
            more = step.join(pairs, step.last == pairs.a).where((F.col("b") > F.col("first")) & ~F.array_contains("path", F.col("b")))
            step = more.select("first", F.col("b").alias("last"), F.concat("path", F.array("b")).alias("path"))
    return out


def tree_paths(g: PropertyGraph, relations: tuple[str, ...] = ("contains", "method", "imports", "imports_from"), deepest: int = 6) -> DataFrame:
    """GR25, SNK7: (depth, path) of labels from roots down, each level a join with the children."""
    e = g.edges.where(F.col("relation").isin(*relations)).select("src", "tgt").distinct()
    labels = g.nodes.select("id", "label")
    roots = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("tgt").alias("id")), "id", "left_anti")
    level = roots.join(labels, "id").select("id", F.lit(0).cast("long").alias("depth"), F.col("label").alias("path"), F.array("id").alias("seen"))
    out = level
    for depth in range(1, deepest + 1):
        below = level.join(e, level.id == e.src).where(~F.array_contains("seen", F.col("tgt")))
        below = below.join(labels.withColumnsRenamed({"id": "tgt", "label": "below"}), "tgt")
        level = cut(below.select(F.col("tgt").alias("id"), F.lit(depth).cast("long").alias("depth"), F.concat_ws(" / ", "path", "below").alias("path"), F.concat("seen", F.array("tgt")).alias("seen")))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out.select("depth", "path")


def hierarchy(g: PropertyGraph, relation: str = "contains", deepest: int = 4) -> DataFrame:
    """JN31: (owner, id, distance): how far down each owner's tree a node is."""
    e = g.edges.where(F.col("relation") == relation).select("src", "tgt").distinct()
    now = e.select(F.col("src").alias("owner"), F.col("tgt").alias("id"), F.lit(1).cast("long").alias("distance"))
    out = now
    for d in range(2, deepest + 1):
        now = now.join(e, now.id == e.src).select("owner", F.col("tgt").alias("id"), F.lit(d).cast("long").alias("distance"))
        out = out.unionByName(now)
    return out.groupBy("owner", "id").agg(F.min("distance").alias("distance"))


def dfs(g: PropertyGraph, seed: str, depth: int = 2) -> DataFrame:
    """GR7: (place, id): the depth-first visit from a node over neighbours by id; hubs other than it are reached but not passed.

    The visit depends on its own order, so that one task makes it.  That task gets the arcs out of
    nodes that the visit may pass, in order, and keeps them in files; the driver gathers none.  An
    unknown node gives no rows.
    """
    depth = min(depth, DEEPEST)
    adj = cut(adjacency(known_edges(g)))
    open_nodes = _open_nodes(g)
    start = cut(g.nodes.where(F.col("id") == seed).select("id").distinct())
    ball, size = numbered(_levels(adj, open_nodes, start, depth), "id", cut)
    at = ball.where("hop = 0").select("num").first()
    if at is None:
        return g.nodes.select(F.lit(0).cast("long").alias("place"), "id").limit(0)
    first = at["num"]
    passed = ball.where(F.col("hop") < depth)
    passed = passed.join(open_nodes.unionByName(start).distinct(), "id", "left_semi").select(F.col("id").alias("node"), F.col("num").alias("a"))
    arcs = passed.join(adj, "node").join(ball.select(F.col("id").alias("other"), F.col("num").alias("b")), "other").select("a", "b")
    # The loop makes sure that there is a row.
    arcs = arcs.union(start.select(F.lit(first).cast("long"), F.lit(first).cast("long")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            kept, last, n = Arcs(folder, {"head": "<i8", "begin": "<i8", "other": "<i8"}), -1, 0
            for b in batches:
                nodes = b.column(0).to_numpy()
                if not len(nodes):
                    continue
                new = np.flatnonzero(np.diff(nodes, prepend=last))
                kept.add(head=nodes[new], begin=new + n, other=b.column(1).to_numpy())
                last, n = nodes[-1], n + len(nodes)
            if not n:
                return
            kept.add(begin=np.array([n]))
            arrays = kept.arrays()
            head, begin, other = arrays["head"], arrays["begin"], arrays["other"]
            seen = np.memmap(f"{folder}/seen", "?", "w+", shape=(size,))

            def below(node: int) -> np.ndarray:
                i = int(np.searchsorted(head, node))
                return np.asarray(other[begin[i] : begin[i + 1]]) if i < len(head) and head[i] == node else np.empty(0, "<i8")

            seen[first] = True
            place, order, held = 0, [np.array([first])], 1
            stack = [(below(first), 0)] if depth > 0 else []
            while stack:
                near, i = stack.pop()
                if len(stack) + 1 == depth:
                    fresh = near[~seen[near]]
                    seen[fresh] = True
                    order.append(fresh)
                    held += len(fresh)
                else:
                    left = np.flatnonzero(~seen[near[i:]])
                    if not len(left):
                        continue
                    i += int(left[0])
                    stack += [(near, i + 1), (below(near[i]), 0)]
                    seen[near[i]] = True
                    order.append(near[i : i + 1])
                    held += 1
                if held >= ROWS:
                    yield from rows(["place", "num"], [np.arange(place, place + held), np.concatenate(order)])
                    place, order, held = place + held, [], 0
            if held:
                yield from rows(["place", "num"], [np.arange(place, place + held), np.concatenate(order)])
            del head, begin, other, seen, arrays

    made = arcs.repartition(1).sortWithinPartitions("a", "b").mapInArrow(visit, "place long, num long")
    return made.join(ball.select("id", "num"), "num").select("place", "id")
