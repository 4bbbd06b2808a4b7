"""Exports: Cypher, GraphML, canonical JSON, names, grids, budgets, a report, and label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import PropertyGraph, cut
from tessera.operators.measures import confidences, god_nodes, known_edges


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(g: PropertyGraph) -> DataFrame:
    """SNK6: one statement a row; relations in capitals, other signs as underscores."""
    label = F.coalesce("label", F.lit(""))
    n = g.nodes.select(F.concat(F.lit("MERGE (n:Node {id: "), _quoted(F.col("id")), F.lit("}) SET n.label = "), _quoted(label), F.lit(";")).alias("line"))
    relation = F.regexp_replace(F.upper("relation"), "[^A-Z0-9]", "_")
    e = g.edges.select(F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("src")), F.lit("}), (b {id: "), _quoted(F.col("tgt")), F.lit("}) MERGE (a)-[:"), relation, F.lit("]->(b);")).alias("line"))
    return n.unionByName(e)


def xml_text(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def graphml(g: PropertyGraph) -> DataFrame:
    """SNK5: (part, line): the elements of nodes and edges; a writer puts head and foot around them."""
    n = g.nodes.select(F.lit("node").alias("part"), F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('"><data key="label">'), xml_text(F.col("label")), F.lit("</data></node>")).alias("line"))
    return n.unionByName(g.edges.select(F.lit("edge").alias("part"), F.concat(F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("tgt")), F.lit('"><data key="relation">'), xml_text(F.col("relation")), F.lit("</data></edge>")).alias("line")))


def canonical(g: PropertyGraph) -> DataFrame:
    """ST10: (part, line): rows as JSON with fields in one order, without what may change; sort to compare."""
    n = g.nodes.select(F.lit("node").alias("part"), F.concat_ws("|", "id", "label", "file_type", "source_file").alias("line"))
    return n.unionByName(g.edges.select(F.lit("edge").alias("part"), F.concat_ws("|", "src", "tgt", "relation").alias("line")))


def digest(lines: DataFrame) -> DataFrame:
    """(part, n, digest): a hash of all lines that doesn't depend on their order, by adding up parts of each one's."""
    h = F.sha2("line", 256)
    part = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")
    sums = lines.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(part(i)).alias(f"h{i}") for i in range(3)])
    return sums.select("part", "n", F.concat_ws("-", *[F.col(f"h{i}").cast("string") for i in range(3)]).alias("digest"))


def write_graph(g: PropertyGraph, path: str, force: bool = False) -> bool:
    """SNK1, SNK4: nodes and edges as Parquet below path; refuses to replace a graph with more nodes unless forced."""
    spark = g.nodes.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    if there and not force and spark.read.parquet(f"{path}/nodes").count() > g.nodes.count():
        return False
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")
    return True


def file_names(nodes: DataFrame) -> DataFrame:
    """SNK15, WIN15: (id, name): labels as file names; those that differ in case only get _1, _2 and so on in node order."""
    stem = F.when(F.trim(F.col("label")) == "", F.col("id")).otherwise(F.regexp_replace("label", r'[\\/:*?"<>|#^\[\]]', "_"))
    n = nodes.withColumn("stem", stem)
    place = F.row_number().over(Window.partitionBy(F.lower("stem")).orderBy("node_ord")) - 1
    return n.withColumn("k", place).select("id", F.when(F.col("k") == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.col("k").cast("string"))).alias("name"))


def grid(nodes: DataFrame, step: int = 240) -> DataFrame:
    """SNK14: (id, x, y): each community's nodes on a square grid in order."""
    w = Window.partitionBy("community")
    n = nodes.where("community is not null").withColumn("k", F.row_number().over(w.orderBy("node_ord")) - 1).withColumn("side", F.ceil(F.sqrt(F.count("*").over(w))))
    return n.select("id", (F.col("k") % F.col("side") * step).cast("long").alias("x"), (F.floor(F.col("k") / F.col("side")) * step).cast("long").alias("y"))


def budget_cut(lines: DataFrame, order: list, tokens: int) -> DataFrame:
    """SNK21, WIN13: the first lines, in order, within three characters a token; a line and its end count.

    The order is one of the whole text, which a budget keeps short.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lines.orderBy(*order).limit(tokens * 3)  # each line has a character at least
    return first.withColumn("upto", F.sum(F.length("line") + 1).over(w)).where(F.col("upto") <= tokens * 3).drop("upto")


def propagate(g: PropertyGraph, rounds: int = 5) -> DataFrame:
    """CL1: (id, community) by label propagation: each node takes the most frequent label around it, ties by name.

    Rounds are joins; odd and even ones move alternate halves of the nodes, so that labels settle.
    """
    e = known_edges(g).where("src <> tgt").select("src", "tgt")
    adj = cut(e.union(e.select("tgt", "src")).toDF("node", "other").distinct())
    now = cut(g.nodes.select("id", F.col("id").alias("label")).distinct())
    for i in range(rounds):
        votes = adj.join(now.withColumnRenamed("id", "other"), "other").groupBy("node", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("b")).select(F.col("node").alias("id"), F.col("b.label").alias("new"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        now = cut(now.join(best, "id", "left").select("id", F.when(moves, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label")))
    return now.select("id", F.col("label").alias("community"))


def report(g: PropertyGraph) -> str:
    """SNK8: a short report in Markdown, from small aggregates."""
    out = ["# Graph report", "", "## Confidence"]
    out += [f"- {r.confidence}: {r.n} ({r.percent}%)" for r in confidences(g).orderBy("confidence").collect()]
    out += ["", "## Best connected"] + [f"- {r.label} ({r.degree})" for r in god_nodes(g).collect()]
    return "\n".join(out) + "\n"
