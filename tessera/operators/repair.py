"""Normalizing, repairing and ordering of graphs that producers wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.model import PropertyGraph, canonical_file_type
from tessera.operators.sets import keep_one

# The order in which pull requests are listed.
PR_ORDER = ("WRONG-BASE", "CI-FAIL", "CHANGES-REQ", "DRAFT", "STALE", "PENDING", "APPROVED", "READY")


def normalized(nodes: DataFrame, root: str) -> DataFrame:
    """BD2: nodes with paths below root, slashes and known file types."""
    return nodes.withColumns({"source_file": P.relative(F.col("source_file"), root), "file_type": canonical_file_type(F.col("file_type"))})


def id_remap(nodes: DataFrame) -> DataFrame:
    """BD3: (old, new) of ids that begin with the last part of their path only; new ones begin with the whole path.

    An old id that several new ones claim is left alone.
    """
    prefixes = P.id_prefixes(F.col("source_file"))
    n = nodes.where("source_file <> ''").select("id", prefixes.alias("p")).where(F.size("p") > 1)
    n = n.withColumn("short", F.element_at("p", -1)).withColumn("whole", F.element_at("p", 1))
    hit = n.where((F.col("id") == F.col("short")) | F.startswith("id", F.concat("short", F.lit("_")))).where(~((F.col("id") == F.col("whole")) | F.startswith("id", F.concat("whole", F.lit("_")))))
    new = hit.select(F.col("id").alias("old"), F.concat("whole", F.substr(F.col("id"), F.length("short") + 1)).alias("new"))
    return new.groupBy("old").agg(F.count_distinct("new").alias("n"), F.min("new").alias("new")).where("n = 1").select("old", "new")


def legacy_aliases(nodes: DataFrame) -> DataFrame:
    """BD7: (alias, id): names that older producers gave a node, each meant for one node only.

    They are the last part of the path, the last two, and the last part with the label.
    """
    slug = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    n = nodes.where("source_file <> ''").select("id", P.id_prefixes(F.col("source_file")).alias("p"), slug(F.col("label")).alias("l")).where(F.size("p") > 0)
    last = F.element_at("p", -1)
    names = F.array(F.concat(last, F.lit("_"), F.col("l")), last, F.when(F.size("p") > 1, F.element_at("p", -2)))
    rows = n.select("id", F.explode(F.array_distinct(F.array_compact(names))).alias("alias")).where("alias <> id")
    one = rows.groupBy("alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("alias", "id")
    return one.join(nodes.select(F.col("id").alias("alias")), "alias", "left_anti")


def has_legacy_ids(nodes: DataFrame) -> bool:
    """BD10: whether an id begins with a part of its path where the whole should be."""
    return bool(id_remap(nodes).limit(1).count())


def collapse_reverse(edges: DataFrame, order: str) -> DataFrame:
    """BD9: of edges between the same two nodes with one relation, either way round, the first."""
    e = edges.withColumns({"_a": F.least("src", "tgt"), "_b": F.greatest("src", "tgt")})
    return keep_one(e, ["_a", "_b", "relation"], F.col(order), False).drop("_a", "_b")


def sorted_distinct(g: PropertyGraph) -> PropertyGraph:
    """SET8: nodes by id and edges by ends and relation, the first of each, in that order."""
    nodes = keep_one(g.nodes, ["id"], F.struct("node_ord", "label"), False).orderBy("id")
    rest = [c for c in g.edges.columns if c not in ("src", "tgt", "relation")]
    edges = keep_one(g.edges, ["src", "tgt", "relation"], F.struct(*rest), False)
    return PropertyGraph(nodes, edges.orderBy("src", "tgt", "relation"))


def remapped(nodes: DataFrame, mapping: DataFrame, names: DataFrame) -> DataFrame:
    """SET11: nodes under matched community ids (new, id), with the names (community, community_name) of old ones."""
    m = mapping.select(F.col("new").alias("community"), F.col("id").alias("_to"))
    moved = nodes.join(m, "community", "left").withColumn("community", F.coalesce("_to", "community")).drop("_to")
    return moved.join(names, "community", "left")


def attach_hyperedges(old: DataFrame, new: DataFrame) -> DataFrame:
    """SET13: old hyperedges and the first of each new id."""
    fresh = keep_one(new, ["id"], F.col("ord"), False).join(old.select("id"), "id", "left_anti")
    return old.unionByName(fresh)


def changed_paths(paths: DataFrame) -> DataFrame:
    """SET15: (path, ord): paths in the order in which they came first."""
    return paths.groupBy("path").agg(F.min("ord").alias("ord"))


def merge_three(base: PropertyGraph, ours: PropertyGraph, theirs: PropertyGraph) -> PropertyGraph:
    """SET12: all that any of three versions has; a later version's row wins: theirs, then ours."""
    def rows(part: str) -> DataFrame:
        parts = [getattr(g, part).withColumn("_v", F.lit(v)) for v, g in enumerate((base, ours, theirs))]
        return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)

    pick = lambda df, key: keep_one(df, key, F.col("_v"), True).drop("_v")
    return PropertyGraph(pick(rows("nodes"), ["id"]), pick(rows("edges"), ["src", "tgt", "relation"]))


def keeps_identity(file_type: Column, origin: Column, diagram: Column, dot_id: Column) -> Column:
    """DD4: code, packages, enrichments and named diagram entities are never merged by label."""
    held = (file_type == "code") | F.coalesce(origin.isin("document_package", "enrichment"), F.lit(False))
    return held | (F.coalesce(diagram == "graphviz", F.lit(False)) & dot_id.isNotNull())


def anchored_apart(type_a: Column, file_a: Column, type_b: Column, file_b: Column) -> Column:
    """DD5: rationales and documents of different files are never merged."""
    return (file_a != file_b) & (type_a.isin("rationale", "document") | type_b.isin("rationale", "document"))


def fill_missing(nodes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """DD8: the first row of each key with its null columns filled from later rows, the first value each."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return nodes.groupBy(key).agg(F.min(order).alias(order), *[first(c) for c in columns])


def first_labels(nodes: DataFrame, top: int) -> DataFrame:
    """WIN8: (community, rank, label): the first labels of each community in input order.

    The least rows are kept by an aggregate of bounded state, so that no community is one group.
    """
    named = nodes.where("community is not null").withColumn("name", F.when(F.col("label") == "", F.col("id")).otherwise(F.col("label"))).where("name <> ''")
    # Ranks inside slices of a community first, so that none is sorted whole.
    piece = named.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = piece.withColumn("_r", F.row_number().over(Window.partitionBy("community", "_s").orderBy("node_ord"))).where(F.col("_r") <= top)
    rank = F.row_number().over(Window.partitionBy("community").orderBy("node_ord"))
    return some.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("community", "rank", F.col("name").alias("label"))


def label_batches(nodes: DataFrame, of: DataFrame, per: int, top: int) -> DataFrame:
    """TOP15: (batch, community, size, leads): communities by size in batches, led by their best connected nodes.

    of: (id, degree).  Only communities are ranked in one task.
    """
    sizes = nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("size"))
    turn = F.row_number().over(Window.orderBy(F.desc("size"), "community")) - 1
    ranked = sizes.withColumn("batch", F.floor(turn / per).cast("long"))
    n = nodes.where("community is not null").join(of, "id").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = [F.desc("degree"), F.col("id")]
    some = n.withColumn("_r", F.row_number().over(Window.partitionBy("community", "_s").orderBy(*order))).where(F.col("_r") <= top)
    leads = some.withColumn("_r", F.row_number().over(Window.partitionBy("community").orderBy(*order))).where(F.col("_r") <= top)
    leads = leads.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]), "; ").alias("leads"))
    return ranked.join(leads, "community").select("batch", "community", "size", "leads")


def pr_listing(prs: DataFrame, base: str, order: tuple[str, ...] = PR_ORDER) -> DataFrame:
    """TOP10: (pr, status, days, rank) of pull requests on base, by the place of their status, then by age."""
    place = F.array_position(F.lit(list(order)), F.col("status"))
    listed = prs.where(F.col("base") == base).withColumn("_p", F.when(place == 0, len(order) + 1).otherwise(place))
    return listed.withColumn("rank", F.row_number().over(Window.orderBy("_p", "days", "pr")).cast("long")).select("pr", "status", "days", "rank")


def edge_of_pairs(pairs: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """GR11: (a, b, src, tgt, relation): the first stored edge between two nodes, either way round."""
    e = edges.select(F.least("src", "tgt").alias("x"), F.greatest("src", "tgt").alias("y"), "src", "tgt", "relation", F.col(order).alias("_o"))
    first = e.groupBy("x", "y").agg(F.min_by(F.struct("src", "tgt", "relation"), F.struct("_o", "src", "tgt", "relation")).alias("e"))
    p = pairs.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return p.join(first, ["x", "y"]).select("a", "b", "e.*")


def resolve_seeds(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """GR18, GR19: (query, id): the node that each name means, where that is beyond doubt.

    In turn: its id; the only node of that label; of that label but for (); of that file; of its
    file the one that stands for the file (on line L1 with the file's name, else on L1, else of that
    name); the only label that contains the name.  nodes may have a column source_location.
    """
    n = nodes if "source_location" in nodes.columns else nodes.withColumn("source_location", F.lit(None).cast("string"))
    n = n.select("id", F.lower("label").alias("norm"), P.bare_name(F.col("label")).alias("bare"), F.lower("source_file").alias("file"), (F.col("source_location") == "L1").alias("l1"))
    text = F.regexp_replace("query", r"[/\\]+$", "")
    q = queries.select("query").distinct().withColumn("_q", F.when(text == "", "/").otherwise(text))
    q = q.withColumns({"norm": F.lower("_q"), "bare": P.bare_name(F.col("_q")), "base": F.element_at(F.split(F.lower("_q"), r"[/\\]"), -1)})

    def only(rows: DataFrame, tier: int) -> DataFrame:
        return rows.groupBy("query").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("query", "id", F.lit(tier).alias("tier"))

    k = q.select("query", "_q", F.col("norm").alias("qn"), F.col("bare").alias("qb"), "base")
    by_file = k.join(n, F.col("qn") == F.col("file"))
    first = F.coalesce("l1", F.lit(False))
    found = only(k.join(n, F.col("_q") == F.col("id")), 0)
    steps = [k.join(n, F.col("qn") == F.col("norm")), k.join(n, F.col("qb") == F.col("bare")), by_file, by_file.where(first & (F.col("norm") == F.col("base"))), by_file.where(first), by_file.where("norm = base")]
    for tier, rows in enumerate(steps, 1):
        found = found.unionByName(only(rows, tier))
    # Names are few: they are broadcast to the nodes, whose labels are read once.
    found = found.unionByName(only(n.join(F.broadcast(k), F.contains(F.col("norm"), F.col("qn"))), 9))
    return keep_one(found, ["query"], F.col("tier"), False).select("query", "id")


def overview(g: PropertyGraph, of: DataFrame, top: int) -> DataFrame:
    """AGG9: (kind, name, n): counts, best connected nodes and files by their nodes."""
    counts = g.nodes.agg(F.count("*").alias("n")).select(F.lit("count").alias("kind"), F.lit("nodes").alias("name"), "n")
    counts = counts.unionByName(g.edges.agg(F.count("*").alias("n")).select(F.lit("count").alias("kind"), F.lit("edges").alias("name"), "n"))
    counts = counts.unionByName(g.nodes.agg(F.count_distinct("community").alias("n")).select(F.lit("count").alias("kind"), F.lit("communities").alias("name"), "n"))
    hubs = of.orderBy(F.desc("degree"), "id").limit(top).select(F.lit("hub").alias("kind"), F.col("id").alias("name"), F.col("degree").alias("n"))
    files = g.nodes.where("source_file <> ''").groupBy("source_file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_file").limit(top)
    return counts.unionByName(hubs).unionByName(files.select(F.lit("file").alias("kind"), F.col("source_file").alias("name"), "n"))


def audit(g: PropertyGraph) -> DataFrame:
    """AGG19: (severity, code, n) of what is wrong with a graph's rows; only codes that occur."""
    n, e = g.nodes, g.edges
    ids = n.select("id").distinct()
    node = n.select(F.explode(F.array_compact(F.array(
        F.when(F.coalesce("label", F.lit("")) == "", F.struct(F.lit("warning").alias("severity"), F.lit("node.label").alias("code"))),
        F.when(F.coalesce("source_file", F.lit("")) == "", F.struct(F.lit("info").alias("severity"), F.lit("node.source").alias("code"))),
    ))).alias("x")).select("x.*")
    twice = n.groupBy("id").count().where("count > 1").select(F.lit("error").alias("severity"), F.lit("node.duplicate").alias("code"))
    loops = e.where("src = tgt").select(F.lit("warning").alias("severity"), F.lit("edge.loop").alias("code"))
    loose = [e.join(ids, F.col(end) == F.col("id"), "left_anti").select(F.lit("error").alias("severity"), F.lit(f"edge.{end}").alias("code")) for end in ("src", "tgt")]
    out = node
    for part in (twice, loops, *loose):
        out = out.unionByName(part)
    return out.groupBy("severity", "code").agg(F.count("*").alias("n"))
