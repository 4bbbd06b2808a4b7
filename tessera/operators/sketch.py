"""MinHash sketches, token costs and the checks around clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import query_terms
from tessera.model import PropertyGraph, cut
from tessera.operators.measures import known_edges
from tessera.operators.search import score_nodes, searchable
from tessera.operators.traverse import bfs, induced_edges

#: A community above this part of all nodes, or this size, is split.
LARGEST, AT_LEAST = 4, 10
#: Communities of so many nodes or more are split if fewer of their pairs are linked.
DENSE_FROM, DENSITY = 50, 0.05
#: Clustering refuses larger graphs only if it is given these limits.
NODE_LIMIT, EDGE_LIMIT = 1_000_000, 8_000_000


def sketch(text: str | None, permutations: int = 32, k: int = 3) -> list[int]:
    """FN22: for each permutation the smallest of the mixed codes of the text's k-grams of characters (k at most 3)."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    k = max(1, min(k, len(codes)))
    grams = np.zeros(max(1, len(codes) - k + 1), dtype=np.uint64)
    for i in range(k if len(codes) else 0):
        grams = (grams << np.uint64(21)) | codes[i : len(codes) - k + 1 + i]
    x = np.unique(grams)[None, :] + np.arange(1, permutations + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).min(axis=1).view(np.int64).tolist()


def minhash(text: Column, permutations: int = 32, k: int = 3) -> Column:
    """The sketch of each text, as a Pandas UDF."""
    return F.pandas_udf(lambda s: s.map(lambda t: sketch(t, permutations, k)), T.ArrayType(T.LongType()))(text)


def sketch_similarity(a: Column, b: Column) -> Column:
    """FN23: the part of equal places."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def lsh_bands(threshold: float, permutations: int) -> tuple[int, int]:
    """FN25: bands and rows whose curve has the least area of errors around the threshold."""
    def errors(b: int, r: int) -> float:
        steps = [(i + 0.5) / 200 for i in range(200)]
        return sum((1 - (1 - s**r) ** b) if s < threshold else (1 - s**r) ** b for s in steps)

    return min(((b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)), key=lambda x: (errors(*x), x))


def sketch_pairs(docs: DataFrame, threshold: float = 0.7, permutations: int = 32) -> DataFrame:
    """FN24: (a, b, similarity) of sketches at least this similar, found by equal bands. docs: id, text.

    Texts of one sketch are a class, led by its smallest id: each other member gets one row with its
    leader, of similarity 1, and classes meet by their leaders only, so that many copies bring no
    pairs among themselves.
    """
    bands, rows = lsh_bands(threshold, permutations)
    s = cut(docs.select("id", minhash(F.col("text"), permutations).alias("sketch")))
    leaders = cut(s.groupBy("sketch").agg(F.min("id").alias("id")))
    copies = s.join(leaders.withColumnRenamed("id", "a"), "sketch").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    keyed = leaders.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice("sketch", i * rows + 1, rows)))).alias("band", "key"))
    met = keyed.select("band", "key", F.col("id").alias("a")).join(keyed.select("band", "key", F.col("id").alias("b")), ["band", "key"]).where("a < b").select("a", "b").distinct()
    both = met.join(leaders.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(leaders.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
    near = both.select("a", "b", sketch_similarity(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold)
    return copies.unionByName(near)


def subgraph_tokens(g: PropertyGraph, question: str, depth: int = 3, ascii_labels: bool = False) -> int:
    """AGG24: a quarter of the bytes of the text around the three nodes that match most terms."""
    nodes = searchable(g, ascii_labels)
    terms = query_terms(question)
    if not terms:
        return 0
    hits = sum((F.contains("norm", F.lit(t)).cast("int") for t in terms[1:]), F.contains("norm", F.lit(terms[0])).cast("int"))
    seeds = nodes.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), "node_ord").limit(3).select("id")
    visited = cut(bfs(g, seeds, depth))
    size = visited.join(g.nodes.select("id", "label", "source_file"), "id").agg(F.sum(F.octet_length("label") + F.octet_length("source_file") + 8)).first()[0] or 0
    edges = induced_edges(g, visited).agg(F.sum(F.octet_length("a") + F.octet_length("b") + F.octet_length("relations") + 8)).first()[0] or 0
    return (size + edges) // 4


def token_benchmark(g: PropertyGraph, questions: list[str], corpus_words: int | None = None, ascii_labels: bool = False) -> dict:
    """AGG23: how many times fewer tokens a subgraph takes than the corpus, on average over the questions."""
    words = corpus_words if corpus_words is not None else 50 * g.nodes.count()
    corpus = words * 100 // 75
    each = [t for q in questions if (t := subgraph_tokens(g, q, ascii_labels=ascii_labels))]
    mean = sum(each) / len(each) if each else 0
    return {"corpus_tokens": corpus, "query_tokens": mean, "reduction": round(corpus / mean, 1) if mean else 0.0}


def split_marks(g: PropertyGraph) -> DataFrame:
    """CL2: (community, size, reason): communities that are too large, or large and thinly linked."""
    n = g.nodes.where("community is not null").select("id", "community")
    total = g.nodes.agg(F.greatest(F.lit(AT_LEAST), F.expr(f"count(*) div {LARGEST}")).alias("most"))
    sizes = n.groupBy("community").agg(F.count("*").alias("size"))
    e = known_edges(g).where("src <> tgt").select(F.least("src", "tgt").alias("x"), F.greatest("src", "tgt").alias("y")).distinct()
    inner = e.join(n.withColumnsRenamed({"id": "x", "community": "cx"}), "x").join(n.withColumnsRenamed({"id": "y", "community": "cy"}), "y").where("cx = cy").groupBy(F.col("cx").alias("community")).agg(F.count("*").alias("pairs"))
    c = sizes.join(inner, "community", "left").join(F.broadcast(total), how="cross")
    density = F.coalesce("pairs", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2)
    reason = F.when(F.col("size") > F.col("most"), "oversized").when((F.col("size") >= DENSE_FROM) & (density < DENSITY), "sparse")
    return c.select("community", "size", reason.alias("reason")).where("reason is not null")


def singletons(g: PropertyGraph) -> DataFrame:
    """CL3: (id) of nodes without an edge inside their community; they are communities of their own."""
    n = g.nodes.where("community is not null").select("id", "community")
    e = known_edges(g).where("src <> tgt").select("src", "tgt")
    inner = e.join(n.withColumnsRenamed({"id": "src", "community": "a"}), "src").join(n.withColumnsRenamed({"id": "tgt", "community": "b"}), "tgt").where("a = b")
    linked = inner.select(F.col("src").alias("id")).union(inner.select("tgt"))
    return n.select("id").join(linked, "id", "left_anti")


def within_limits(g: PropertyGraph, nodes: int = NODE_LIMIT, edges: int = EDGE_LIMIT) -> bool:
    """CL7: whether a graph is below limits, for callers that set some; no operator here needs them."""
    return g.nodes.limit(nodes + 1).count() <= nodes and g.edges.limit(edges + 1).count() <= edges


def best_matches(g: PropertyGraph, question: str, top: int = 10) -> DataFrame:
    """GR13: the best scored nodes of a question."""
    return score_nodes(searchable(g), query_terms(question)).orderBy(F.desc("score"), F.length("label"), "id").limit(top)
