"""Building a graph from facts: repair of ends, reasons of drops, validation and conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize_id_udf
from tessera.model import numeric

# Where facts about structure come from, and where others do.
STRUCTURAL = ("ast", "fallback", "terraform", "sql", "dotnet", "scip", "diagram", "pdf", "document_package")
SEMANTIC = ("semantic", "enrichment")
SELF_IMPORTS = ("imports", "imports_from", "re_exports")


def ascii_normal(c: Column) -> Column:
    """normalize_id for ASCII ids, as a built-in expression."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_")), "^_+|_+$", "")


def repair_ends(values: DataFrame, nodes: DataFrame, remap: DataFrame | None = None, aliases: DataFrame | None = None, ascii_ids: bool = False) -> DataFrame:
    """JN1: (value, id, tier) of each end: by remap, exactly, by a normalized id or an alias that only one node has, or not.

    values: value.  remap: value, id.  aliases: alias, id.
    """
    normal = ascii_normal if ascii_ids else lambda c: normalize_id_udf(c)
    v = values.select("value").distinct().withColumn("key", normal(F.col("value")))
    ids = nodes.select("id").distinct()
    v = v.join(ids.select(F.col("id").alias("exact")), F.col("value") == F.col("exact"), "left")
    lone = lambda d: d.groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("found")).where("n = 1").select("key", "found")
    v = v.join(lone(ids.withColumn("key", normal(F.col("id")))).withColumnRenamed("found", "normal"), "key", "left")
    if aliases is not None:
        v = v.join(lone(aliases.select("id", normal(F.col("alias")).alias("key"))).withColumnRenamed("found", "legacy"), "key", "left")
    else:
        v = v.withColumn("legacy", F.lit(None).cast("string"))
    if remap is not None:
        m = remap.join(ids, "id", "left_semi").select("value", F.col("id").alias("moved"))
        v = v.join(m, "value", "left")
    else:
        v = v.withColumn("moved", F.lit(None).cast("string"))
    tier = F.when(F.col("moved").isNotNull(), "remap").when(F.col("exact").isNotNull(), "exact").when(F.col("normal").isNotNull(), "normalized").when(F.col("legacy").isNotNull(), "legacy").otherwise("unresolved")
    return v.select("value", F.coalesce("moved", "exact", "normal", "legacy").alias("id"), tier.alias("tier"))


def edge_fates(edges: DataFrame, repaired: DataFrame, family: Column | None = None) -> DataFrame:
    """AGG17, FLT19, FLT20: edges with repaired ends and the reason, if any, why each is dropped.

    family: an expression over src_id and tgt_id that tells ends of different language families.
    """
    e = edges
    for end in ("src", "tgt"):
        e = e.join(repaired.select(F.col("value").alias(end), F.col("id").alias(f"{end}_id")), end, "left")
    lost = F.col("src_id").isNull() | F.col("tgt_id").isNull()
    itself = (F.col("src_id") == F.col("tgt_id")) & F.col("relation").isin(*SELF_IMPORTS)
    reason = F.when(lost, "unresolved_endpoint").when(itself, "import_self_loop")
    if family is not None:
        reason = reason.when(family, "cross_language")
    return e.withColumn("reason", reason)


def drop_reasons(fates: DataFrame) -> DataFrame:
    """(reason, n): how many edges each reason drops, and repeats of a key among those that stay."""
    dropped = fates.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    kept = fates.where("reason is null").groupBy("src_id", "tgt_id", "relation").agg((F.count("*") - 1).alias("n"))
    return dropped.unionByName(kept.agg(F.lit("duplicate_key").alias("reason"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def conservation(fates: DataFrame) -> DataFrame:
    """AGG18: one row (input, output, dropped, accounted)."""
    out = fates.where("reason is null").select("src_id", "tgt_id", "relation").distinct().agg(F.count("*").alias("output"))
    all_ = fates.agg(F.count("*").alias("input"))
    dropped = drop_reasons(fates).agg(F.sum("n").alias("dropped"))
    return all_.join(out, how="cross").join(dropped, how="cross").withColumn("accounted", F.col("input") == F.col("output") + F.col("dropped"))


def weights(edges: DataFrame, column: str = "weight") -> DataFrame:
    """FN42: the column as a number of at least zero, or 1."""
    return edges.withColumn(column, numeric(F.col(column)))


def violations(nodes: DataFrame, edges: DataFrame, file_types: tuple[str, ...], confidences: tuple[str, ...]) -> DataFrame:
    """AGG21: (kind, subject, problem) of every violation, not the first only."""
    out = None
    add = lambda d: d if out is None else out.unionByName(d)
    for field in ("id", "label", "file_type", "source_file"):
        bad = nodes.where(F.col(field).isNull()).select(F.lit("node").alias("kind"), F.coalesce("id", F.lit("?")).alias("subject"), F.lit(f"missing {field}").alias("problem"))
        out = add(bad)
    out = add(nodes.where(~F.col("file_type").isin(*file_types)).select(F.lit("node").alias("kind"), F.col("id").alias("subject"), F.concat(F.lit("invalid file_type "), "file_type").alias("problem")))
    name = F.concat_ws(" -> ", F.coalesce("src", F.lit("?")), F.coalesce("tgt", F.lit("?")))
    for field in ("src", "tgt", "relation", "confidence"):
        out = add(edges.where(F.col(field).isNull()).select(F.lit("edge").alias("kind"), name.alias("subject"), F.lit(f"missing {field}").alias("problem")))
    out = add(edges.where(~F.col("confidence").isin(*confidences)).select(F.lit("edge").alias("kind"), name.alias("subject"), F.concat(F.lit("invalid confidence "), "confidence").alias("problem")))
    ids = nodes.select("id").distinct()
    for end in ("src", "tgt"):
        lone = edges.where(F.col(end).isNotNull()).join(ids, edges[end] == ids.id, "left_anti")
        out = add(lone.select(F.lit("edge").alias("kind"), name.alias("subject"), F.concat(F.lit(f"unknown {end} "), end).alias("problem")))
    return out


def hyperedge_members(hyperedges: DataFrame, repaired: DataFrame) -> DataFrame:
    """BD8: (id, place, member): resolved members in order, each once; hyperedges without a member vanish."""
    m = hyperedges.select("id", F.posexplode("nodes").alias("place", "value")).join(repaired.select("value", F.col("id").alias("member")), "value").where("member is not null")
    return m.groupBy("id", "member").agg(F.min("place").cast("long").alias("place")).select("id", "place", "member")


def twins(nodes: DataFrame) -> DataFrame:
    """BD5: (id, to): a node x whose file also has x_doc goes into it."""
    docs = nodes.where(F.endswith("id", F.lit("_doc"))).select(F.expr("substring(id, 1, length(id) - 4)").alias("id"), F.col("id").alias("to"), "source_file")
    return nodes.select("id", "source_file").join(docs, ["id", "source_file"]).select("id", "to")


def ghosts(nodes: DataFrame) -> DataFrame:
    """BD6: (id, to): a node that isn't structural goes into the only structural one of its file and label."""
    solid = nodes.where(F.col("origin").isin(*STRUCTURAL)).groupBy("source_file", "label").agg(F.count("*").alias("n"), F.min("id").alias("to")).where("n = 1")
    return nodes.where(~F.col("origin").isin(*STRUCTURAL)).join(solid, ["source_file", "label"]).select("id", "to")
