"""A property graph from the relational star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import PropertyGraph, lookup, shared_folder, stored

#: A kind's nodes come before those of the next kind; keys are below this.
KIND = 1_000_000_000_000
CONFIDENCE = {"F": "EXTRACTED", "O": "INFERRED", "P": "AMBIGUOUS"}


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema; a path's schema is read from its footers once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _nodes(df: DataFrame, kind: int, name: str, key: str, label: str, file_type: str, source, community) -> DataFrame:
    k = F.col(key).cast("long")
    return df.select(F.concat(F.lit(f"{name}:"), k.cast("string")).alias("id"), F.col(label).alias("label"), F.lit(file_type).alias("file_type"), source.alias("source_file"), community.cast("long").alias("community"), (k + kind * KIND).alias("node_ord"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    path = lambda a, c, b: F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))
    out = _nodes(t("region"), 0, "region", "r_regionkey", "r_name", "concept", F.lit("geo/region.md"), F.lit(None))
    out = out.unionByName(_nodes(t("nation"), 1, "nation", "n_nationkey", "n_name", "code", path("geo/r", "n_regionkey", "/nation.py"), F.col("n_nationkey")))
    out = out.unionByName(_nodes(t("customer"), 2, "customer", "c_custkey", "c_name", "code", path("sales/n", "c_nationkey", "/customer.py"), F.col("c_nationkey")))
    out = out.unionByName(_nodes(t("supplier"), 3, "supplier", "s_suppkey", "s_name", "code", path("supply/n", "s_nationkey", "/supplier.rs"), F.col("s_nationkey")))
    return out.unionByName(_nodes(t("part"), 4, "part", "p_partkey", "p_name", "document", path("catalog/", "p_brand", ".md"), F.col("p_partkey") % 25))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("long").cast("string"))

    def rows(df, src, tgt, relation, confidence, source, context):
        return df.select(src.alias("src"), tgt.alias("tgt"), F.lit(relation).alias("relation"), confidence.alias("confidence"), source.alias("source_file"), context.cast("string").alias("context"))

    none, sure = F.lit(None), F.lit("EXTRACTED")
    path = lambda a, c, b: F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))
    out = rows(t("nation"), name("region", "n_regionkey"), name("nation", "n_nationkey"), "contains", sure, F.lit("geo/region.md"), none)
    region = t("nation").select(F.col("n_nationkey").alias("_n"), "n_regionkey")
    for tab, kind, key, nation in (("customer", "customer", "c_custkey", "c_nationkey"), ("supplier", "supplier", "s_suppkey", "s_nationkey")):
        placed = t(tab).join(region, F.col(nation) == F.col("_n"))
        out = out.unionByName(rows(placed, name("nation", nation), name(kind, key), "contains", sure, path("geo/r", "n_regionkey", "/nation.py"), none))
    first = t("lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey", "l_partkey")
    calls = first.join(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    calls = calls.groupBy("o_custkey", "l_suppkey").agg(F.min("o_orderstatus").alias("status"))
    calls = calls.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.unionByName(rows(calls, name("customer", "o_custkey"), name("supplier", "l_suppkey"), "calls", lookup(F.col("status"), CONFIDENCE), path("sales/n", "c_nationkey", "/customer.py"), F.lit("invocation")))
    uses = first.select("l_suppkey", "l_partkey").distinct().join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return out.unionByName(rows(uses, name("supplier", "l_suppkey"), name("part", "l_partkey"), "uses", F.lit("INFERRED"), path("supply/n", "s_nationkey", "/supplier.rs"), F.lit("params")))


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers and parts with what they contain, call and use."""
    return PropertyGraph(nodes(spark, sf_dir), edges(spark, sf_dir))


_STORED: dict[tuple[str, str], PropertyGraph] = {}


def stored_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The star graph as a stored graph: built and written on first use in an application, then read.

    Questions are asked of a graph that exists, as in the engine; the tables below sf_dir don't change.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = stored(star_graph(spark, sf_dir), f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}")
    return _STORED[key]
