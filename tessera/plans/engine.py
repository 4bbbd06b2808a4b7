"""The engine: builds, updates, asks and exports a graph that is stored as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import PropertyGraph
from tessera.operators import analysis, cluster, export, languages, measures, sets, traverse
from tessera.sources import documents, files, scopes


class Engine:
    """API1 to API10: one graph at a path; questions return DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def graph(self) -> PropertyGraph:
        return PropertyGraph(self.spark.read.parquet(f"{self.path}/nodes"), self.spark.read.parquet(f"{self.path}/edges"))

    def extract(self, root: str, ignore: list[str] = ()) -> PropertyGraph:
        """Facts of all covered files below root as a graph."""
        found = files.discover(self.spark, root, ignore).where("status = 'covered'").select("path", "relative")
        read = documents.read_files(self.spark, root).join(found, "path").select(F.col("relative").alias("path"), "content")
        return to_graph(documents.facts(read))

    def bindings(self, root: str, ignore: list[str] = ()) -> DataFrame:
        """(src, tgt, relation): bases and calls that bind across the files below root, by language."""
        found = files.discover(self.spark, root, ignore).where("status = 'covered'").select("path", "relative")
        read = documents.read_files(self.spark, root).join(found, "path").select(F.col("relative").alias("path"), "content")
        return languages.resolve(scopes.scopes(read))

    def build(self, root: str, ignore: list[str] = (), force: bool = False) -> bool:
        """API4: extracts root and stores the graph, unless it would lose nodes without force."""
        return export.write_graph(self.extract(root, ignore), self.path, force)

    def update(self, new: PropertyGraph, removed: DataFrame | None = None) -> PropertyGraph:
        """API5: the stored graph with the facts of new in place of those of the same files, and without removed files."""
        old = self.graph()
        if removed is not None:
            old = sets.prune_sources(old, removed)
        owned = new.nodes.select("source_file").distinct()
        nodes = old.nodes.join(owned, "source_file", "left_anti").unionByName(new.nodes, allowMissingColumns=True)
        edges = old.edges.join(owned, "source_file", "left_anti").unionByName(new.edges, allowMissingColumns=True)
        return PropertyGraph(nodes, edges)

    def query(self, question: str, depth: int = 2) -> DataFrame:
        """API1, API3: the subgraph of a question; depth is at most 6."""
        return traverse.question_subgraph(self.graph(), question, min(depth, traverse.DEEPEST))

    def path_between(self, start: str, end: str, most: int = 8) -> DataFrame:
        return traverse.shortest_path(self.graph(), start, end, most)

    def affected(self, node: str, depth: int = 2) -> DataFrame:
        """API2."""
        return traverse.affected(self.graph(), node, depth)

    def explain(self, node: str) -> DataFrame:
        return traverse.explain(self.graph(), node)

    def god_nodes(self, top: int = 10) -> DataFrame:
        return measures.god_nodes(self.graph(), top)

    def surprises(self, top: int = 5) -> DataFrame:
        return analysis.surprising(self.graph(), top)

    def diagnose(self) -> DataFrame:
        """API6."""
        g = self.graph()
        return measures.diagnostics(g.edges, g.nodes)

    def audit(self) -> DataFrame:
        """API7: dangling edges."""
        return sets.dangling(self.graph())

    def cluster(self, resolution: float = 1.0) -> PropertyGraph:
        """The graph with communities by the Leiden method, numbered by size."""
        g = self.graph()
        numbered = cluster.cluster(g, resolution)
        return PropertyGraph(g.nodes.drop("community").join(numbered, "id", "left"), g.edges)

    def export(self, form: str) -> DataFrame | str:
        """API10: cypher, graphml, json or report."""
        forms: dict[str, Callable] = {"cypher": export.cypher, "graphml": export.graphml, "json": export.canonical, "report": export.report}
        if form not in forms:
            raise ValueError(f"unknown format {form!r}; known are {', '.join(sorted(forms))}")
        return forms[form](self.graph())


def to_graph(facts: DataFrame) -> PropertyGraph:
    """Facts as nodes and edges; code is what parsers of programs give, all else documents."""
    n = facts.where("kind = 'node'").groupBy("id").agg(F.min_by(F.struct("label", "type", "source_file", "line"), F.struct("source_file", "line")).alias("x"))
    n = n.select("id", "x.label", F.when(F.col("x.type").isin("class", "function", "method"), "code").otherwise("document").alias("file_type"), "x.source_file", F.lit(None).cast("long").alias("community"), F.xxhash64("id").alias("node_ord"))
    e = facts.where("kind = 'edge'").select(F.col("id").alias("src"), F.col("parent").alias("tgt"), F.col("type").alias("relation"), F.lit("EXTRACTED").alias("confidence"), "source_file", F.lit(None).cast("string").alias("context")).distinct()
    return PropertyGraph(n, e)
