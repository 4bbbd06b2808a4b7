"""Surprising connections, questions and architecture sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import PropertyGraph, lookup
from tessera.operators.measures import degrees, is_concept, is_file_node, isolated

# File extensions by category and by language family.
CODE = (
    "py pyw ts tsx mts cts js jsx mjs cjs ejs ets go rs java groovy gradle cpp cc cxx c h hpp cu cuh metal rb rake swift kt kts cs scala php lua luau toc zig ps1 psm1 psd1 ex exs m mm jl vue svelte astro dart v sv svh "
    "sql r f f90 f95 f03 f08 pas pp dpr dpk lpr inc dfm lfm lpk sh bash json tf tfvars hcl dm dme dmi dmm dmf sln slnx csproj fsproj vbproj xaml razor cshtml cls trigger"
).split()
CATEGORY = {"pdf": "paper"} | dict.fromkeys(CODE, "code") | dict.fromkeys("png jpg jpeg gif webp svg".split(), "image")
FAMILY = (
    dict.fromkeys("py pyw".split(), "python") | dict.fromkeys("js jsx mjs cjs ejs ts tsx mts cts vue svelte".split(), "js") | {"go": "go", "rs": "rust", "swift": "swift", "cs": "dotnet", "php": "php", "r": "r"}
    | dict.fromkeys("java kt kts scala".split(), "jvm") | dict.fromkeys("c h cpp cc cxx hpp".split(), "c") | dict.fromkeys("rb rake".split(), "ruby")
)
OWNING = ("imports", "imports_from", "contains", "method")


def extension(path: Column) -> Column:
    """The ending of a file name in lower case, or null."""
    found = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    return F.when(found != "", found)


def file_category(path: Column) -> Column:
    """FN27: code, paper, image or doc by extension."""
    return F.coalesce(lookup(extension(path), CATEGORY), F.lit("doc"))


def language_family(path: Column) -> Column:
    """FN28: the language family by extension, or null."""
    return lookup(extension(path), FAMILY)


def top_dir(path: Column) -> Column:
    """FN29: the first part of a path."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def _with_ends(g: PropertyGraph) -> DataFrame:
    n = g.nodes.join(degrees(g), "id").select("id", "label", F.col("source_file").alias("file"), "community", "degree")
    e = g.edges
    for end, p in (("src", "s"), ("tgt", "t")):
        e = e.join(n.select(F.col("id").alias(end), *[F.col(c).alias(f"{p}_{c}") for c in ("label", "file", "community", "degree")]), end)
    return e


def surprise_score(e: DataFrame) -> Column:
    """FN26: how unexpected an edge is: unsure, across file types, directories or communities, or from the edge to a hub."""
    cs, ct = file_category(F.col("s_file")), file_category(F.col("t_file"))
    fs, ft = language_family(F.col("s_file")), language_family(F.col("t_file"))
    foreign = F.coalesce(fs != ft, F.lit(False))
    code_doc = F.array_contains(F.array(cs, ct), F.lit("code")) & F.array_contains(F.array(cs, ct), F.lit("doc"))
    muted = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & (foreign | code_doc)
    base = lookup(F.col("confidence"), {"AMBIGUOUS": 3, "INFERRED": 2, "EXTRACTED": 1})
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = base + yes(cs != ct, 2) + yes(top_dir(F.col("s_file")) != top_dir(F.col("t_file")), 2) + yes(F.col("s_community") != F.col("t_community"), 1)
    score = F.when(muted, 0).otherwise(score)
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score)
    low, high = F.least("s_degree", "t_degree"), F.greatest("s_degree", "t_degree")
    return (score + yes((low <= 2) & (high >= 5), 1)).cast("long")


def cross_file(g: PropertyGraph) -> DataFrame:
    """TOP5: (src, tgt, relation, score) of edges between files, without ownership, concepts and file nodes."""
    e = _with_ends(g).where(~F.col("relation").isin(*OWNING) & (F.col("s_file") != F.col("t_file")))
    for p in ("s", "t"):
        e = e.where(~is_concept(F.col(f"{p}_file")) & ~is_file_node(F.col(f"{p}_label"), F.col(f"{p}_file"), F.col(f"{p}_degree")))
    return e.select("src", "tgt", "relation", F.col("s_label").alias("label"), surprise_score(e).alias("score"))


def surprising(g: PropertyGraph, top: int = 5) -> DataFrame:
    """The most surprising edges between files; ties by source label, then ends."""
    return cross_file(g).orderBy(F.desc("score"), "label", "src", "tgt").limit(top).select("src", "tgt", "relation", "score")


def surprising_communities(g: PropertyGraph) -> DataFrame:
    """WIN9: one edge for each pair of communities, the least sure first, then by its ends."""
    e = _with_ends(g).where("s_community <> t_community").where(~F.col("relation").isin(*OWNING))
    rank = lookup(F.col("confidence"), {"AMBIGUOUS": 0, "INFERRED": 1, "EXTRACTED": 2})
    best = e.groupBy(F.least("s_community", "t_community").alias("a"), F.greatest("s_community", "t_community").alias("b")).agg(F.min(F.struct(rank.alias("rank"), "src", "tgt", "relation", "confidence")).alias("x"))
    return best.select("a", "b", "x.src", "x.tgt", "x.relation", "x.confidence")


def questions(g: PropertyGraph, top: int = 10) -> DataFrame:
    """TOP6: (kind, question): what unsure edges mean, in order of their ends, then what joins weakly linked nodes."""
    unsure = _with_ends(g).where("confidence = 'AMBIGUOUS'").orderBy("src", "tgt", "relation").limit(top)
    asked = unsure.select(F.lit("ambiguous_edge").alias("kind"), F.format_string("What is the exact relationship between `%s` and `%s`?", "s_label", "t_label").alias("question"), F.struct("src", "tgt", "relation").cast("string").alias("o"))
    lone = isolated(g).join(g.nodes.select("id", "node_ord"), "id")
    first = lone.orderBy("node_ord").limit(3).agg(F.array_sort(F.collect_list(F.struct("node_ord", "label"))).alias("l"))
    names = F.array_join(F.transform("l", lambda x: F.concat(F.lit("`"), x["label"], F.lit("`"))), ", ")
    rest = first.where(F.size("l") > 0).select(F.lit("isolated_nodes").alias("kind"), F.format_string("What connects %s to the rest of the system?", names).alias("question"), F.lit("~").alias("o"))
    return asked.unionByName(rest).orderBy(F.col("kind"), "o").limit(top).select("kind", "question")


def sections(g: PropertyGraph, keywords: dict[str, list[str]], least: int = 2) -> DataFrame:
    """SNK11: (community, section, hits): the section whose keywords a community's texts hold most often, the last on a tie."""
    words = g.nodes.where("community is not null").select("community", F.explode(F.split(F.lower(F.concat_ws(" ", "label", "source_file", "file_type")), "[^a-z0-9]+")).alias("word"))
    counts = words.where("word <> ''").groupBy("community", "word").agg(F.count("*").alias("n"))
    table = g.nodes.sparkSession.createDataFrame([(i, s, k) for i, (s, ks) in enumerate(keywords.items()) for k in ks], "place int, section string, word string")
    hits = counts.join(F.broadcast(table), "word").groupBy("community", "section", "place").agg(F.sum("n").alias("hits"))
    best = hits.groupBy("community").agg(F.max(F.struct("hits", "place", "section")).alias("b"))
    all_ = g.nodes.where("community is not null").select("community").distinct()
    named = F.when(F.col("b.hits") >= least, F.col("b.section")).otherwise("other")
    return all_.join(best, "community", "left").select("community", named.alias("section"), F.coalesce("b.hits", F.lit(0)).alias("hits"))
