"""Aggregates over a graph: degrees, hubs, confidences, communities, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import PropertyGraph

# Labels that rankings of nodes leave out.
ANALYSIS_NOISE = tuple(
    "str int float bool bytes bytearray complex object True False MagicMock Mock AsyncMock NonCallableMock NonCallableMagicMock PropertyMock patch sentinel "
    "Path Any Optional List Dict Set Tuple Union Callable Type ClassVar Final Literal Protocol Counter defaultdict OrderedDict datetime Enum os sys re json io abc typing "
    "Foundation SwiftUI UIKit AppKit Combine String Int Double Float Bool Data URL Date UUID Sendable Codable Decodable Encodable Equatable Hashable Identifiable Comparable "
    "AnyObject Error LocalizedError NSObject NSString NSError NSLock View Color Font DispatchQueue".split()
)
QUERY_NOISE = tuple("str int float bool object Path Any Optional List Dict Set Tuple Union Foundation SwiftUI String Int Data".split())
JSON_NOISE = tuple(
    "start end name id type properties value key data items title description version dependencies devdependencies peerdependencies optionaldependencies bundleddependencies bundledependencies".split()
)
#: A hub has at least so many edges.
HUB_FLOOR = 50


def known_edges(g: PropertyGraph) -> DataFrame:
    """JN3: edges whose two ends are nodes."""
    ids = g.nodes.select("id")
    return g.edges.join(ids, g.edges.src == ids.id, "left_semi").join(ids, g.edges.tgt == ids.id, "left_semi")


def degrees(g: PropertyGraph) -> DataFrame:
    """AGG1, JN2: (id, degree) of every node; an edge counts at each known end, a loop once."""
    ends = known_edges(g).select(F.explode(F.when(F.col("src") == F.col("tgt"), F.array("src")).otherwise(F.array("src", "tgt"))).alias("id"))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return g.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def pair_degrees(g: PropertyGraph) -> DataFrame:
    """AGG2: (id, degree) over distinct unordered pairs; a loop counts twice."""
    pairs = known_edges(g).select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hub_threshold(g: PropertyGraph, floor: int = HUB_FLOOR) -> DataFrame:
    """WIN14: one row (threshold): the degree at place floor(n * 99 / 100) of the sorted degrees, at least floor.

    """
    return hub_floor(degrees(g), floor)


def hub_floor(of: DataFrame, floor: int = HUB_FLOOR) -> DataFrame:
    """hub_threshold from known degrees.

    The place is found in their histogram, a table as long as there are different degrees.
    """
    histogram = of.groupBy("degree").agg(F.count("*").alias("n"))
    upto = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = histogram.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(total))
    at = F.floor(F.col("all") * 99 / 100)
    return placed.where(F.col("upto") > at).agg(F.greatest(F.min("degree"), F.lit(floor)).cast("long").alias("threshold"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def is_file_node(label: Column, source: Column, degree: Column) -> Column:
    """FLT5: a node that stands for a file, or a method or lone function."""
    path = F.replace(source, F.lit("\\"), F.lit("/"))
    as_file = (source != "") & ((label == basename(source)) | (F.contains(label, F.lit("/")) & ((path == label) | F.endswith(path, F.concat(F.lit("/"), label)))))
    call = F.endswith(label, F.lit("()"))
    return (label != "") & (as_file | (F.startswith(label, F.lit(".")) & call) | (call & (degree <= 1)))


def is_concept(source: Column) -> Column:
    """FLT6: no file, or a file without an extension."""
    return (source == "") | ~F.contains(basename(source), F.lit("."))


def is_json_key(label: Column, source: Column) -> Column:
    """FLT7: an everyday key of a JSON file."""
    return F.endswith(F.lower(source), F.lit(".json")) & F.lower(F.trim(label)).isin(*JSON_NOISE)


def god_nodes(g: PropertyGraph, top: int = 10) -> DataFrame:
    """TOP1: (id, label, degree) of the best connected nodes, ties in input order."""
    n = g.nodes.join(degrees(g), "id")
    n = n.where(~is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) & ~is_concept(F.col("source_file")) & ~is_json_key(F.col("label"), F.col("source_file")) & ~F.col("label").isin(*ANALYSIS_NOISE))
    named = F.when(F.col("label") == "", F.col("id")).otherwise(F.col("label")).alias("label")
    return n.orderBy(F.desc("degree"), "node_ord").limit(top).select("id", named, "degree")


def god_nodes_query(g: PropertyGraph, top: int = 10) -> DataFrame:
    """TOP2: the ranking that queries use: other exclusions, ties by id."""
    n = g.nodes.join(degrees(g), "id").where((F.col("file_type") != "concept") & ~F.col("label").isin(*QUERY_NOISE))
    n = n.where((F.col("label") != basename(F.col("source_file"))) & ~(F.startswith(F.col("label"), F.lit(".")) & F.endswith(F.col("label"), F.lit("()"))))
    return n.orderBy(F.desc("degree"), "id").limit(top).select("id", "label", "degree")


def confidences(g: PropertyGraph) -> DataFrame:
    """AGG3: (confidence, n, percent), the percentage cut to an integer."""
    total = g.edges.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    counts = g.edges.groupBy("confidence").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total), how="cross").select("confidence", "n", F.expr("(100 * n) div total").alias("percent"))


def stats(g: PropertyGraph) -> DataFrame:
    """GR21: one row of counts."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities"), F.count_distinct("source_file").alias("files"))
    e = g.edges.agg(F.count("*").alias("edges"), F.count_distinct("relation").alias("relations"))
    return n.join(e, how="cross")


def members(g: PropertyGraph) -> DataFrame:
    """AGG4, AGG5: (community, size, fingerprint); the fingerprint hashes the sorted members, each with a NUL behind it."""
    grouped = g.nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("ids"))
    text = F.concat(F.array_join("ids", "\0"), F.lit("\0"))
    return grouped.select("community", "size", F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def cohesion(g: PropertyGraph) -> DataFrame:
    """AGG6, AGG7: (community, size, cohesion): distinct pairs that are linked, of all pairs; 1 for a single member."""
    c = g.nodes.where("community is not null").select("id", "community")
    sizes = c.groupBy("community").agg(F.count("*").alias("size"))
    a, b = c.select(F.col("id").alias("src"), F.col("community").alias("ca")), c.select(F.col("id").alias("tgt"), F.col("community").alias("cb"))
    inside = g.edges.where("src <> tgt").select("src", "tgt").join(a, "src").join(b, "tgt").where("ca = cb")
    pairs = inside.select(F.col("ca").alias("community"), F.least("src", "tgt").alias("x"), F.greatest("src", "tgt").alias("y")).distinct().groupBy("community").agg(F.count("*").alias("pairs"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    score = F.when(F.col("size") <= 1, 1.0).otherwise(F.coalesce("pairs", F.lit(0)) / possible)
    return sizes.join(pairs, "community", "left").select("community", "size", F.round(score, 6).alias("cohesion"))


def hub_labels(g: PropertyGraph) -> DataFrame:
    """CL5, AGG2: (community, hub, label): each community's node of most distinct neighbours, ties by id; one () is cut off."""
    n = g.nodes.where("community is not null").join(pair_degrees(g), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    # The least of (-degree, id) is the hub, as an aggregate that combines before the shuffle.
    best = n.groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), "id", "label")).alias("b"))
    return best.select("community", F.col("b.id").alias("hub"), F.regexp_replace("b.label", r"\(\)$", "").alias("label"))


def diagnostics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG10 to AGG12: one row on repeated, dangling and looping edges and on pairs whose edges differ."""
    ids = nodes.select("id").distinct()
    e = edges.join(ids.withColumnRenamed("id", "_s").withColumn("has_s", F.lit(True)), F.col("src") == F.col("_s"), "left").join(ids.withColumnRenamed("id", "_t").withColumn("has_t", F.lit(True)), F.col("tgt") == F.col("_t"), "left")
    e = e.withColumn("dangling", F.col("has_s").isNull() | F.col("has_t").isNull())
    totals = e.agg(F.count("*").alias("raw_edges"), F.count_if("dangling").alias("dangling"), F.count_if(F.col("src") == F.col("tgt")).alias("self_loops"))
    keyed = edges.groupBy("src", "tgt", "relation").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"))
    pairs = edges.groupBy("src", "tgt").agg(F.count("*").alias("n"), F.count_distinct("relation").alias("relations"), F.count_distinct("source_file").alias("files"), F.count_distinct("context").alias("contexts"))
    pairs = pairs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("same_endpoint_extra"), F.count_if(F.col("relations") > 1).alias("relation_variants"), F.count_if(F.col("files") > 1).alias("file_variants"), F.count_if(F.col("contexts") > 1).alias("context_variants"))
    return totals.join(keyed, how="cross").join(pairs, how="cross")


def isolated(g: PropertyGraph) -> DataFrame:
    """Nodes with at most one edge that stand for neither a file nor a concept."""
    n = g.nodes.join(degrees(g), "id").where("degree <= 1")
    return n.where(~is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) & ~is_concept(F.col("source_file"))).select("id", "label", "degree")


def community_sizes(assigned: DataFrame) -> DataFrame:
    """TOP11, CL4: (id, community) numbered anew by size, then by the sorted members.

    assigned: id, old community.  No two communities share a member, so that their smallest ones
    decide.  The window ranks one narrow row a community, in one task.
    """
    groups = assigned.groupBy("community").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    ranked = groups.withColumn("new", F.row_number().over(Window.orderBy(F.desc("size"), "least")) - 1).select("community", F.col("new").cast("long"))
    return assigned.join(ranked, "community").select("id", F.col("new").alias("community"))
