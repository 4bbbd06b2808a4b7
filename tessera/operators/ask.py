"""Questions as users put them: contexts that their words hint at, and the ways a subgraph is found."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import search_tokens
from tessera.model import PropertyGraph, cut
from tessera.operators import analysis, measures, traverse
from tessera.operators.search import pick_seeds
from tessera.operators.sets import CONTEXT_NAMES, context_filter

# Words of a question that hint at a context.
CONTEXT_HINTS = {
    "call": ("call", "calls", "called", "invoke", "invokes", "invoked"),
    "import": ("import", "imports", "imported", "module", "modules"),
    "field": ("field", "fields", "member", "members", "property", "properties"),
    "parameter_type": ("parameter", "parameters", "param", "params", "argument", "arguments"),
    "return_type": ("return", "returns", "returned"),
    "generic_arg": ("generic", "generics", "template", "templates"),
}


def contexts(question: str, explicit: list[str] = ()) -> tuple[list[str], str | None]:
    """FLT3: the contexts that are asked for, or else those that the question's words hint at, and which of both."""
    low = [f.strip().lower() for f in explicit]
    named = list(dict.fromkeys(CONTEXT_NAMES.get(f, f) for f in low if f))
    if named:
        return named, "explicit"
    words = set(search_tokens(question))
    hinted = [c for c, hints in CONTEXT_HINTS.items() if words & set(hints)]
    return hinted, "heuristic" if hinted else None


def ask_filtered(g: PropertyGraph, question: str, filters: list[str] = (), depth: int = 2, ascii_labels: bool = False) -> DataFrame:
    """GR8: the subgraph of a question in a graph of the named contexts only; its seeds are scored there."""
    narrow = PropertyGraph(g.nodes, context_filter(g.edges, list(filters)))
    return traverse.question_subgraph(narrow, question, depth, ascii_labels)


def ask(g: PropertyGraph, question: str, explicit: list[str] = (), depth: int = 2, ascii_labels: bool = False) -> DataFrame:
    """GR3: seeds are scored on the whole graph; the walk then keeps to the contexts asked for or hinted at."""
    seeds = cut(pick_seeds(g, question, ascii_labels=ascii_labels))
    narrow = PropertyGraph(g.nodes, context_filter(g.edges, contexts(question, explicit)[0]))
    visited = cut(traverse.bfs(narrow, seeds, depth))
    none = F.lit(None).cast("string")
    nodes = visited.select(F.lit("node").alias("kind"), F.col("id").alias("src"), none.alias("tgt"), none.alias("relation"), "hop")
    edges = traverse.induced_edges(narrow, visited).select(F.lit("edge").alias("kind"), F.col("a").alias("src"), F.col("b").alias("tgt"), F.col("relations").alias("relation"), F.lit(None).cast("long").alias("hop"))
    return nodes.unionByName(edges)


def ask_deep(g: PropertyGraph, question: str, filters: list[str] = (), depth: int = 2, ascii_labels: bool = False) -> DataFrame:
    """GR2: (id, place): depth-first visits from a question's seeds, one after the other, each node once."""
    narrow = PropertyGraph(g.nodes, context_filter(g.edges, list(filters)))
    seeds = [r.id for r in pick_seeds(narrow, question, ascii_labels=ascii_labels).orderBy("rank").collect()]
    out = None
    for i, seed in enumerate(seeds):
        part = traverse.dfs(narrow, seed, depth).withColumn("turn", F.lit(i))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return g.nodes.select("id", F.lit(0).cast("long").alias("place")).limit(0)
    first = out.groupBy("id").agg(F.min(F.struct("turn", "place")).alias("b"))
    return first.select("id", (F.col("b.turn") * (1 << 32) + F.col("b.place")).cast("long").alias("place"))


def path_within(path: DataFrame, most: int) -> DataFrame:
    """GR15: a path, or no rows where it has more than most hops."""
    hops = path.agg(F.count("*").alias("n")).where(F.col("n") <= most + 1)
    return path.join(F.broadcast(hops), how="cross").drop("n")


def edges_between(edges: DataFrame, u: str, v: str) -> DataFrame:
    """GR26: all parallel edges of two nodes, either way round."""
    return edges.where((F.col("src") == u) & (F.col("tgt") == v) | (F.col("src") == v) & (F.col("tgt") == u))


def analyze(g: PropertyGraph) -> dict[str, DataFrame]:
    """GR27: the best connected nodes, surprises and questions of a graph."""
    return {"gods": measures.god_nodes(g, 10), "surprises": analysis.surprising(g, 5), "questions": analysis.questions(g)}


def latency(g: PropertyGraph, question: str, times: int = 5) -> float:
    """GR28: milliseconds a question, on average."""
    start = time.perf_counter()
    for _ in range(times):
        traverse.question_subgraph(g, question).count()
    return (time.perf_counter() - start) * 1000 / times
