"""Filters, set operations and incremental maintenance of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import PropertyGraph, cut, lookup

# Names that contexts go by, and the relations of each family.
CONTEXT_NAMES = {
    "param": "parameter_type", "params": "parameter_type", "parameter": "parameter_type", "parameters": "parameter_type", "argument": "parameter_type", "arguments": "parameter_type", "arg": "parameter_type", "args": "parameter_type",
    "return": "return_type", "returns": "return_type", "returned": "return_type", "generic": "generic_arg", "generics": "generic_arg", "template": "generic_arg", "templates": "generic_arg",
    "annotation": "attribute", "annotations": "attribute", "decorator": "attribute", "decorators": "attribute", "calls": "call", "called": "call", "invoke": "call", "invocation": "call",
    "fields": "field", "property": "field", "properties": "field", "member": "field", "members": "field", "imports": "import", "imported": "import", "module": "import", "modules": "import", "exports": "export", "exported": "export",
}
CONTEXT_RELATIONS = {
    "call": ("calls", "indirect_call"), "calls": ("calls", "indirect_call"), "call_flow": ("calls", "indirect_call"), "call-flow": ("calls", "indirect_call"),
    "import": ("imports", "imports_from", "re_exports"), "imports": ("imports", "imports_from", "re_exports"),
    "type": ("references", "inherits", "implements", "type_ref"), "types": ("references", "inherits", "implements", "type_ref"),
    "structure": ("contains", "method", "case_of"), "contain": ("contains", "method", "case_of"), "contains": ("contains", "method", "case_of"),
}


def context_filter(edges: DataFrame, filters: list[str]) -> DataFrame:
    """FLT1, FLT2: edges of a context, of its family of relations, or else of relations that contain its name."""
    if not filters:
        return edges
    relation = F.lower("relation")
    low = F.trim(F.lower("context"))
    context = lookup(low, CONTEXT_NAMES, low)
    keep = F.lit(False)
    for f in filters:
        name = f.strip().lower()
        name = CONTEXT_NAMES.get(name, name)
        family = relation.isin(*CONTEXT_RELATIONS[name]) if name in CONTEXT_RELATIONS else F.contains(relation, F.lit(name)) if name else F.lit(False)
        keep = keep | F.coalesce(context == name, F.lit(False)) | family
    return edges.where(keep)


def dangling(g: PropertyGraph) -> DataFrame:
    """JN6: (src, tgt, relation, end) of edges and the end that is no node."""
    ids = g.nodes.select(F.col("id"))
    e = g.edges.select("src", "tgt", "relation")
    left = e.join(ids, e.src == ids.id, "left_anti").withColumn("end", F.lit("src"))
    return left.unionByName(e.join(ids, e.tgt == ids.id, "left_anti").withColumn("end", F.lit("tgt")))


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """(id, n) of ids that several nodes have."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN4, SET9: (change, id, label) of nodes that only one graph has."""
    added = new.select("id", "label").join(old.select("id"), "id", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select("id", "label").join(new.select("id"), "id", "left_anti").withColumn("change", F.lit("removed"))).select("change", "id", "label")


def edge_diff(old: DataFrame, new: DataFrame, directed: bool = False) -> DataFrame:
    """JN5: (change, a, b, relation) of edges that only one graph has; a change of confidence is none."""
    def key(e: DataFrame) -> DataFrame:
        a, b = (F.col("src"), F.col("tgt")) if directed else (F.least("src", "tgt"), F.greatest("src", "tgt"))
        return e.select(a.alias("a"), b.alias("b"), "relation").distinct()

    o, n, on = key(old), key(new), ["a", "b", "relation"]
    return n.join(o, on, "left_anti").withColumn("change", F.lit("added")).unionByName(o.join(n, on, "left_anti").withColumn("change", F.lit("removed"))).select("change", "a", "b", "relation")


def prefixed(g: PropertyGraph, tag: str) -> PropertyGraph:
    """SET3, SET5: the graph under ids that begin with tag::, with the tag as repo and the old id as local_id."""
    name = lambda c: F.concat(F.lit(f"{tag}::"), F.col(c))
    nodes = g.nodes.withColumn("local_id", F.col("id")).withColumn("id", name("id")).withColumn("repo", F.lit(tag))
    return PropertyGraph(nodes, g.edges.withColumns({"src": name("src"), "tgt": name("tgt")}))


def union(a: PropertyGraph, b: PropertyGraph) -> PropertyGraph:
    """SET1: both graphs' rows."""
    return PropertyGraph(a.nodes.unionByName(b.nodes, allowMissingColumns=True), a.edges.unionByName(b.edges, allowMissingColumns=True))


def prune_repo(g: PropertyGraph, tag: str) -> PropertyGraph:
    """JN7, SET7: the graph without a repo's nodes and the edges at them."""
    gone = g.nodes.where(F.col("repo") == tag).select("id")
    nodes = g.nodes.join(gone, "id", "left_anti")
    e = g.edges.join(gone, g.edges.src == gone.id, "left_anti")
    return PropertyGraph(nodes, e.join(gone, e.tgt == gone.id, "left_anti"))


def global_add(store: PropertyGraph, g: PropertyGraph, tag: str) -> PropertyGraph:
    """SET6: a repo's graph in the store, in place of its older one.

    Nodes without a source file fold onto a node of the store that has none either and the same
    label; loops go, and of equal edges one stays.
    """
    base, new = prune_repo(store, tag), prefixed(g, tag)
    outside = base.nodes.where("source_file = ''").groupBy("label").agg(F.min("id").alias("to"))
    fold = new.nodes.where("source_file = ''").join(outside, "label").select(F.col("id").alias("from"), "to")
    nodes = new.nodes.join(fold.select(F.col("from").alias("id")), "id", "left_anti")
    e = new.edges
    for end in ("src", "tgt"):
        m = fold.withColumnsRenamed({"from": f"_{end}", "to": f"_{end}_to"})
        e = e.join(m, F.col(end) == F.col(f"_{end}"), "left").withColumn(end, F.coalesce(f"_{end}_to", end)).drop(f"_{end}", f"_{end}_to")
    both = union(base, PropertyGraph(nodes, e.where("src <> tgt")))
    return PropertyGraph(both.nodes, both.edges.dropDuplicates(["src", "tgt", "relation"]))


def keep_one(rows: DataFrame, key: list[str], order: Column, last: bool) -> DataFrame:
    """WIN5 to WIN7: of each key the first or last row in order, by an aggregate that combines before the shuffle."""
    packed = F.struct(*rows.columns)
    best = F.max_by(packed, order) if last else F.min_by(packed, order)
    return rows.groupBy(*key).agg(best.alias("_row")).select("_row.*")


def replace_by_source(old: DataFrame, new: DataFrame, tier: str = "tier") -> DataFrame:
    """JN9, JN10: old facts whose (source_file, tier) was not extracted anew, and all new ones."""
    owned = new.select("source_file", tier).distinct()
    return old.join(owned, ["source_file", tier], "left_anti").unionByName(new, allowMissingColumns=True)


def prune_sources(g: PropertyGraph, sources: DataFrame) -> PropertyGraph:
    """JN8: the graph without the nodes of some files and without the edges at them or from these files."""
    gone = g.nodes.join(sources, "source_file", "left_semi").select("id")
    e = g.edges.join(sources, "source_file", "left_anti")
    e = e.join(gone, e.src == gone.id, "left_anti")
    return PropertyGraph(g.nodes.join(sources, "source_file", "left_anti"), e.join(gone, e.tgt == gone.id, "left_anti"))


def manifest_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """SRC15: (path, status) by comparing states (path, mtime, hash): new, deleted, unchanged, touched or changed."""
    b = before.select("path", F.col("mtime").alias("m0"), F.col("hash").alias("h0"))
    both = b.join(now.select("path", F.col("mtime").alias("m1"), F.col("hash").alias("h1")), "path", "full_outer")
    status = F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "deleted").when(F.col("m0") == F.col("m1"), "unchanged").when(F.col("h0") == F.col("h1"), "touched").otherwise("changed")
    return both.select("path", status.alias("status"))


def community_overlap(before: DataFrame, now: DataFrame) -> DataFrame:
    """SET10: (old, new, n): how many nodes each pair of communities shares."""
    return before.select("id", F.col("community").alias("old")).join(now.select("id", F.col("community").alias("new")), "id").groupBy("old", "new").agg(F.count("*").alias("n"))


def match_communities(overlap: DataFrame, now: DataFrame) -> DataFrame:
    """CL6: (new, id): communities under the ids of the old ones they share most with, one to one.

    Pairs are taken by size, then old, then new; the rest is numbered on by size.  Each round takes
    all pairs that are the best of both their communities, which are the ones that taking them one
    by one would take.  Nothing is collected; the windows rank communities, not nodes.
    """
    pairs = cut(overlap.select("old", "new", F.struct((-F.col("n")).alias("n"), "old", "new").alias("k")))
    taken = pairs.limit(0).select("new", F.col("old").alias("id"))
    while pairs.limit(1).count():
        best = pairs.groupBy("old").agg(F.min("k").alias("k")).select("k").intersect(pairs.groupBy("new").agg(F.min("k").alias("k")).select("k"))
        won = cut(best.select(F.col("k.new").alias("new"), F.col("k.old").alias("id")))
        taken = taken.unionByName(won)
        pairs = cut(pairs.join(won.select("new"), "new", "left_anti").join(won.select(F.col("id").alias("old")), "old", "left_anti").select("old", "new", "k"))
    sizes = now.groupBy("community").agg(F.count("*").alias("size"))
    rest = sizes.join(taken.select(F.col("new").alias("community")), "community", "left_anti")
    rest = rest.select(F.col("community").alias("new"), F.row_number().over(Window.orderBy(F.desc("size"), "community")).alias("turn"))
    count = sizes.count()
    spare = now.sparkSession.range(2 * count + 1).join(taken.select("id"), "id", "left_anti")
    spare = spare.select("id", F.row_number().over(Window.orderBy("id")).alias("turn"))
    return taken.select(F.col("new").cast("long"), F.col("id").cast("long")).unionByName(rest.join(spare, "turn").select(F.col("new").cast("long"), F.col("id").cast("long")))


def shrink_guard(old: DataFrame, new: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """ST8: one row (lost, explained, refused): nodes that went, those of rebuilt files, and whether the rest forbids the write."""
    lost = old.join(new.select("id"), "id", "left_anti")
    row = lost.join(rebuilt.withColumn("_r", F.lit(1)), "source_file", "left").agg(F.count("*").alias("lost"), F.count("_r").alias("explained"))
    return row.withColumn("refused", F.col("lost") > F.col("explained"))


def same_topology(a: DataFrame, b: DataFrame) -> bool:
    """ST9: whether two sets of edges are equal but for what may change."""
    cols = ["src", "tgt", "relation"]
    return not a.select(*cols).exceptAll(b.select(*cols)).limit(1).count() and not b.select(*cols).exceptAll(a.select(*cols)).limit(1).count()


def debounce(events: DataFrame, key: str, ts: str, gap: int, cap: int) -> DataFrame:
    """ST1: (key, batch, first, last, n): changes of a key up to a quiet gap, long sessions cut each cap.

    ts, gap and cap are in one unit, such as microseconds.
    """
    t = F.col(ts)
    w = Window.partitionBy(key).orderBy(ts)
    e = events.withColumn("_new", (F.lag(t).over(w).isNull() | (t - F.lag(t).over(w) > gap)).cast("int"))
    e = e.withColumn("_session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    start = F.min(ts).over(Window.partitionBy(key, "_session"))
    e = e.withColumn("_part", F.floor((t - start) / cap))
    batch = e.groupBy(key, "_session", "_part").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return batch.select(key, F.col("_session").cast("long").alias("session"), F.col("_part").cast("long").alias("part"), "first", "last", "n")
