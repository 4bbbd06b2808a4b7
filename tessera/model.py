"""The property graph: nodes, edges and hyperedges as DataFrames, each row with an explicit place in the order."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that every producer of facts gives.
NODE_COLUMNS = ["id", "label", "file_type", "source_file", "community", "node_ord"]
EDGE_COLUMNS = ["src", "tgt", "relation", "confidence", "source_file", "context"]

# Scores of confidences, and names that file types go by.
CONFIDENCE_SCORE = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
FILE_TYPE_ALIASES = {"markdown": "document", "text": "document", "tool": "code", "library": "code", "pattern": "concept", "principle": "concept"}


@dataclass
class PropertyGraph:
    """nodes(id, label, file_type, source_file, community, node_ord), edges(src, tgt, relation, confidence, source_file, context)."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None
    directed: bool = False
    meta: dict = field(default_factory=dict)


def stored(g: PropertyGraph, path: str) -> PropertyGraph:
    """The graph as Parquet below path, so that plans prune columns, push filters down and know sizes."""
    for name, df in (("nodes", g.nodes), ("edges", g.edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    read = g.nodes.sparkSession.read
    return PropertyGraph(read.schema(g.nodes.schema).parquet(f"{path}/nodes"), read.schema(g.edges.schema).parquet(f"{path}/edges"), g.hyperedges, g.directed, g.meta)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one where it is unset."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def lookup(column: Column, table: dict[str, object], default: Column | None = None) -> Column:
    """A small fixed table as an expression."""
    out = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)
    return out if default is None else F.coalesce(out, default)


def default_score(confidence: Column) -> Column:
    """The score of a confidence where none is given."""
    return lookup(confidence, CONFIDENCE_SCORE)


def canonical_file_type(value: Column) -> Column:
    """A file type under its own name; unknown ones are concepts."""
    low = F.lower(F.trim(value))
    named = lookup(low, FILE_TYPE_ALIASES, low)
    return F.when(named.isin(*FILE_TYPES), named).otherwise("concept")


def true_direction(source: Column, target: Column, marked_source: Column, marked_target: Column) -> tuple[Column, Column]:
    """Source and target of an edge: markers count only if they name exactly the stored pair, either way round."""
    named = (marked_source == source) & (marked_target == target) | (marked_source == target) & (marked_target == source)
    named = F.coalesce(named, F.lit(False))
    return F.when(named, marked_source).otherwise(source), F.when(named, marked_target).otherwise(target)


def numeric(value: Column) -> Column:
    """A weight: a finite number or numeric string of at least zero, or else 1."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x != float("inf")), x).otherwise(F.lit(1.0))
