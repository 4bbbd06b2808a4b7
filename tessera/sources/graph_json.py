"""Graphs in node-link JSON files: read with a cap on size, older names folded, malformed rows counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import FILE_TYPES, PropertyGraph

#: Bytes of a file above which reading is refused.
DEFAULT_CAP = 512 << 20
# Names that file types in older files go by.
OLD_TYPES = {"markdown": "document", "text": "document", "tool": "code", "library": "code"}
_PARTS = "struct<nodes: array<string>, links: array<string>, edges: array<string>, hyperedges: array<string>>"


def size_cap(text: str | None) -> int:
    """SRC3: bytes of a number with MB, GB or nothing behind it; the default for all else."""
    raw = (text or "").strip().upper()
    unit = {"GB": 1 << 30, "MB": 1 << 20}.get(raw[-2:], 1)
    digits = (raw if unit == 1 else raw[:-2]).strip()
    return int(digits) * unit if digits.isascii() and digits.isdigit() and 0 < int(digits) * unit < 1 << 64 else DEFAULT_CAP


def digests(spark: SparkSession, path: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """SRC2: (path, bytes, sha256) of files; those above the cap have no digest."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.when(F.col("length") <= cap, F.sha2("content", 256)).alias("sha256"))


def _own(fields: Column, *names: str) -> Column:
    """The first of the fields that is no empty text."""
    return F.coalesce(*[F.nullif(F.element_at(fields, n), F.lit("")) for n in names], F.lit(""))


def rows(spark: SparkSession, path: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """(path, part, place, fields): each node, link and hyperedge as a map of its fields' texts.

    A file is one JSON value and so one row of a task; files above the cap are refused with an error.
    fields is null where the row is no object.  Links go by edges in older files.
    """
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > cap).select("path").take(1)
    if large:
        raise ValueError(f"{large[0].path} has more than {cap} bytes")
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", _PARTS).alias("v"))

    def listed(part: str, column: Column) -> Column:
        whole = F.coalesce(column, F.array().cast("array<string>"))
        return F.transform(whole, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("place"), x.alias("x")))

    parts = [listed("node", F.col("v.nodes")), listed("link", F.coalesce("v.links", "v.edges")), listed("hyperedge", F.col("v.hyperedges"))]
    each = text.select("path", F.explode(F.flatten(F.array(*parts))).alias("r"))
    fields = F.when(F.startswith("r.x", F.lit("{")), F.from_json("r.x", "map<string, string>"))
    return each.select("path", "r.part", F.col("r.place").cast("long").alias("place"), fields.alias("fields"))


def issues(found: DataFrame) -> DataFrame:
    """SRC5, AGG20: (part, cause, n) of rows that a graph leaves out and of fields that they lack."""
    f = F.col("fields")
    has = lambda *names: F.coalesce(*[F.element_at(f, n) for n in names], F.lit("")) != ""
    node = F.array(F.when(~has("id"), "no id"), F.when(~has("label", "name"), "no label"))
    link = F.array(F.when(~has("source", "from") | ~has("target", "to"), "no end"), F.when(~has("relation", "type"), "no relation"))
    cause = F.when(f.isNull(), F.array(F.lit("no object"))).when(F.col("part") == "node", node).when(F.col("part") == "link", link).otherwise(F.array(F.when(~has("id"), "no id")))
    return found.select("part", F.explode(F.array_compact(cause)).alias("cause")).groupBy("part", "cause").agg(F.count("*").alias("n"))


def graph(found: DataFrame) -> PropertyGraph:
    """SRC1, SRC4: the graph of rows, under the names of today; rows without an id or an end are left out."""
    f = F.col("fields")
    ok = found.where("fields is not null")
    kind = F.coalesce(F.element_at(f, "file_type"), F.lit(""))
    old = F.create_map(*[F.lit(x) for kv in OLD_TYPES.items() for x in kv])
    nodes = ok.where("part = 'node'").select(
        F.element_at(f, "id").alias("id"), _own(f, "label", "name").alias("label"), F.when(kind.isin(*FILE_TYPES), kind).otherwise(F.coalesce(F.element_at(old, kind), F.lit("concept"))).alias("file_type"),
        _own(f, "source_file", "path", "source").alias("source_file"), F.element_at(f, "community").try_cast("long").alias("community"), F.col("place").alias("node_ord"), F.element_at(f, "source_location").alias("source_location"),
    ).where("id <> ''")
    sure = F.coalesce(F.element_at(f, "confidence"), F.when(F.element_at(f, "confidence_score").isNotNull(), "INFERRED"), F.lit("EXTRACTED"))
    end = lambda a, b: F.when(F.map_contains_key(f, a), F.element_at(f, a)).otherwise(F.element_at(f, b))
    edges = ok.where("part = 'link'").select(
        end("source", "from").alias("src"), end("target", "to").alias("tgt"), _own(f, "relation", "type").alias("relation"), sure.alias("confidence"), F.coalesce(F.element_at(f, "source_file"), F.lit("")).alias("source_file"), F.element_at(f, "context").alias("context"),
    ).where("src <> '' and tgt <> ''")
    members = F.coalesce(*[F.from_json(F.element_at(f, n), "array<string>") for n in ("nodes", "members", "node_ids")])
    hyper = ok.where("part = 'hyperedge'").select(F.element_at(f, "id").alias("id"), members.alias("nodes"), F.col("place").alias("ord")).where("id <> ''")
    return PropertyGraph(nodes, edges, hyper)


def read(spark: SparkSession, path: str, cap: int = DEFAULT_CAP) -> PropertyGraph:
    """SRC1: the graph in node-link JSON files."""
    return graph(rows(spark, path, cap))
