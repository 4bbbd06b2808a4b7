"""Facts from models: fragments that are checked, cleaned, bound to evidence and merged."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sets import keep_one

#: Nodes, edges and characters of an id or label that a fragment may have.
NODES, EDGES, CHARS = 2000, 8000, 512


def salvage_json(raw: str) -> dict:
    """FN58: the JSON object in an answer with fences or prose around it; nothing if there is none."""
    fenced = re.search(r"```(?:json)?\s*(\{.*\})\s*```", raw, re.S)
    body = fenced[1] if fenced else raw[raw.find("{") : raw.rfind("}") + 1]
    try:
        value = json.loads(body)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def salvage_labels(raw: str, wanted: list[int]) -> dict[int, str]:
    """FN59: pairs of community and label, even of a JSON text that is cut off."""
    found = {int(k): v for k, v in re.findall(r'"(\d+)"\s*:\s*"((?:[^"\\]|\\.)+)"', raw)}
    return {k: found[k] for k in wanted if k in found}


def fragment_problems(fragment: dict) -> list[str]:
    """BD12: all that is wrong with a fragment."""
    nodes, edges = fragment.get("nodes"), fragment.get("edges")
    if not isinstance(nodes, list) or not isinstance(edges, list):
        return ["nodes and edges must be lists"]
    out = [f"more than {n} {k}" for k, v, n in (("nodes", nodes, NODES), ("edges", edges, EDGES)) if len(v) > n]
    for i, n in enumerate(nodes):
        if not isinstance(n, dict) or not isinstance(n.get("id"), str) or not n["id"]:
            out.append(f"node {i} has no id")
        elif any(len(str(n.get(k, ""))) > CHARS for k in ("id", "label")):
            out.append(f"node {i} is too long")
    known = {n["id"] for n in nodes if isinstance(n, dict) and isinstance(n.get("id"), str)}
    for i, e in enumerate(edges):
        if not isinstance(e, dict) or e.get("source") not in known or e.get("target") not in known:
            out.append(f"edge {i} has an unknown end")
    return out


def merge_fragments(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET14: of equal ids the first fragment's node, and distinct edges. Both have a column fragment, the order."""
    return keep_one(nodes, ["id"], F.col("fragment"), last=False), edges.groupBy("src", "tgt", "relation").agg(F.min("fragment").alias("fragment"))


def fold_rationales(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """BD13: rationale nodes become text of the nodes they explain, and go with their edges."""
    why = nodes.where("file_type = 'rationale'").select(F.col("id").alias("src"), F.col("label").alias("text"))
    texts = edges.where("relation = 'rationale_for'").join(why, "src").groupBy(F.col("tgt").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("rationale"))
    kept = nodes.where("file_type <> 'rationale'").join(texts, "id", "left")
    gone = why.select("src")
    left = edges.join(gone, "src", "left_anti")
    return kept, left.join(gone.withColumnRenamed("src", "tgt"), "tgt", "left_anti")


def bind_evidence(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """BD14: nodes with verified: whether code has one of its label's identifiers in its file's text.

    sources: source_file, text.  Nodes of other types, or of labels without an identifier, are not judged.
    """
    names = F.array_distinct(F.regexp_extract_all(F.split_part(F.col("label"), F.lit("("), F.lit(1)), F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1)))
    n = nodes.withColumn("_names", names).join(sources.select("source_file", F.col("text").alias("_text")), "source_file", "left")
    there = F.exists("_names", lambda x: F.contains(F.coalesce("_text", F.lit("")), x))
    return n.withColumn("verified", F.when((F.col("file_type") == "code") & (F.size("_names") > 0), there)).drop("_names", "_text")


def adaptive(units: list, run: Callable[[list], dict | None], depth: int = 3) -> list[dict]:
    """BD15: answers for units; a chunk that isn't answered is halved, down to a depth, and else left out."""
    answer = run(units)
    if answer is not None:
        return [answer]
    if depth == 0 or len(units) < 2:
        return []
    half = len(units) // 2
    return adaptive(units[:half], run, depth - 1) + adaptive(units[half:], run, depth - 1)


def summaries(nodes: DataFrame, edges: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """BD11: summary nodes (id, media, label) joined to their media by has_enrichment; fails if a medium is unknown.

    An older summary of the same id is replaced.
    """
    lost = records.join(nodes.select(F.col("id").alias("media")), "media", "left_anti").limit(1).count()
    if lost:
        raise ValueError("a summary's medium is not a node")
    fresh = records.select("id", "label", F.lit("document").alias("file_type"))
    new = nodes.join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)
    links = records.select(F.col("media").alias("src"), F.col("id").alias("tgt"), F.lit("has_enrichment").alias("relation"))
    return new, edges.unionByName(links, allowMissingColumns=True).dropDuplicates(["src", "tgt", "relation"])
