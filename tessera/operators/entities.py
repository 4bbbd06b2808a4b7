"""Entity resolution: exact and fuzzy label merges, components, survivors and rewired edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.model import cut

#: Bits a character that a label needs to be matched, shared shingles, and similarity of a merge.
ENTROPY, SHARED, SIMILAR = 2.5, 0.7, 0.92
#: Labels of so many characters get the bonus for one community, and Jaro across files.
LONG, BONUS = 12, 0.05


def labels(nodes: DataFrame) -> DataFrame:
    """Nodes with a normalized label and its entropy."""
    n = nodes.withColumn("norm", X.normalized_label_udf("label"))
    return n.withColumn("entropy", X.entropy(F.col("norm")))


def first_of_label(n: DataFrame) -> DataFrame:
    """WIN2: the first node, in input order, of each normalized label."""
    return n.groupBy("norm").agg(F.min_by(F.struct(*[c for c in n.columns if c != "norm"]), "node_ord").alias("x")).select("norm", "x.*")


def exact_pairs(n: DataFrame) -> DataFrame:
    """DD6: (a, b): nodes of one label and file to the first of them; concepts of telling labels across files, too."""
    within = n.where("norm <> ''").groupBy("norm", "source_file").agg(F.min_by("id", "node_ord").alias("a"))
    pairs = n.join(within, ["norm", "source_file"]).select("a", F.col("id").alias("b"))
    c = n.where((F.col("file_type") == "concept") & (F.col("entropy") >= ENTROPY))
    across = c.groupBy("norm").agg(F.min_by("id", "node_ord").alias("a"))
    return pairs.unionByName(c.join(across, "norm").select("a", F.col("id").alias("b"))).where("a <> b").distinct()


def shingle_pairs(n: DataFrame, least: float = SHARED, k: int = 3) -> DataFrame:
    """JN17, FN14: (a, b, jaccard) of nodes that share at least so much of their shingles, spaces left out.

    A pair that is near enough shares one of the first shingles of both, in order of rarity (prefix
    filtering): so each node is listed under a few rare shingles, and frequent ones bring no pairs.
    """
    s = n.select("id", X.shingles(F.replace(F.col("norm"), F.lit(" "), F.lit("")), k).alias("grams")).withColumn("size", F.size("grams"))
    each = s.select("id", "size", F.explode("grams").alias("gram"))
    # Cut off, the counts bring no partitioning along, so that a frequent shingle's rows can be split in the join.
    seen = cut(each.groupBy("gram").agg(F.count("*").alias("n")))
    rare = Window.partitionBy("id").orderBy("n", "gram")
    # Of size grams, all but ceil(least * size) - 1 of the rarest ones suffice.
    listed = each.join(seen, "gram").withColumn("r", F.row_number().over(rare)).where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
    left = listed.select("gram", F.col("id").alias("a"), F.col("size").alias("sa"))
    right = listed.select("gram", F.col("id").alias("b"), F.col("size").alias("sb"))
    near = (F.col("a") < F.col("b")) & (F.least("sa", "sb") >= least * F.greatest("sa", "sb"))
    found = left.join(right, "gram").where(near).select("a", "b").distinct()
    found = found.join(s.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(s.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    return found.withColumn("jaccard", X.jaccard(F.col("ga"), F.col("gb"))).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


@F.pandas_udf(T.BooleanType())
def _mergeable(a: pd.Series, b: pd.Series, across: pd.Series, same_community: pd.Series) -> pd.Series:
    def one(x: str, y: str, far: bool, same: bool) -> bool:
        long = max(len(x), len(y)) >= LONG
        score = X.jaro(x, y) if far and long else X.jaro_winkler(x, y)
        if same and min(len(x), len(y)) >= LONG:
            score += BONUS
        prefix = x != y and (x.startswith(y) or y.startswith(x))
        return score >= SIMILAR and not prefix and not X.is_variant_pair(x, y) and not X.numbers_differ(x, y) and not X.blocked_short(x, y, score)

    return pd.Series([one(*r) for r in zip(a, b, across, same_community)], dtype=bool)


def fuzzy_pairs(n: DataFrame) -> DataFrame:
    """DD1, FN15 to FN19: (a, b): labels that are near by shingles and by characters, and no variants of each other.

    Only the first node of a label with enough entropy is matched; code and documents of other files
    keep their identity.
    """
    first = first_of_label(n).where((F.col("entropy") >= ENTROPY) & (F.col("file_type") != "code"))
    pairs = shingle_pairs(first)
    side = lambda p: first.select(F.col("id").alias(p), F.col("norm").alias(f"{p}n"), F.col("source_file").alias(f"{p}f"), F.col("community").alias(f"{p}c"), F.col("file_type").alias(f"{p}t"))
    p = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("across", F.col("af") != F.col("bf"))
    anchored = F.col("across") & (F.col("at").isin("rationale", "document") | F.col("bt").isin("rationale", "document"))
    return p.where(~anchored).where(_mergeable("an", "bn", "across", F.coalesce(F.col("ac") == F.col("bc"), F.lit(False)))).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """DD7: (id, root): nodes of pairs with the smallest id that they are joined to.

    Smaller neighbours are handed on and stars flattened in turn, each round cut by a checkpoint.
    """
    now = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        mins = now.groupBy("u").agg(F.min("v").alias("m"))
        lifted = now.join(mins.withColumnsRenamed({"u": "v", "m": "w"}), "v", "left").select("u", F.coalesce("w", "v").alias("v")).distinct()
        mins = lifted.groupBy("u").agg(F.min("v").alias("m"))
        joined = lifted.join(mins, "u")
        now = cut(joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(mins.select("u", "m")).distinct())
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def winners(n: DataFrame, groups: DataFrame) -> DataFrame:
    """WIN4: (id, winner): of each component the id without a _c<digits> ending, then the shortest, then the first."""
    placed = groups.join(n.select("id", "node_ord"), "id")
    order = F.struct(F.col("id").rlike("_c[0-9]+$"), F.length("id"), "node_ord")
    best = placed.groupBy("root").agg(F.min_by("id", order).alias("winner"))
    return groups.join(best, "root").select("id", "winner")


def rewire(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """DD9, DD3: (src, tgt, relation) between survivors, without new loops and repeats."""
    e = edges.select("src", "tgt", "relation")
    for end in ("src", "tgt"):
        m = merged.select(F.col("id").alias(end), F.col("winner").alias(f"_{end}"))
        e = e.join(m, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return e.where("src <> tgt").distinct()


def collision_survivors(nodes: DataFrame) -> DataFrame:
    """WIN3: of each id the node whose file it names, then of the shortest label, then by label and file."""
    slug = F.regexp_replace(F.lower(F.regexp_replace("source_file", r"\.[^./]*$", "")), "[^a-z0-9]+", "_")
    names = F.startswith(F.col("id"), slug)
    order = F.struct(~names, F.length("label"), "label", "source_file")
    return nodes.groupBy("id").agg(F.min_by(F.struct("label", "source_file"), order).alias("x"), F.count("*").alias("n")).select("id", "x.label", "x.source_file", "n")


def unique_suffixes(files: DataFrame) -> DataFrame:
    """FN30, DD10: (path, suffix): the shortest end of each path that no other path has."""
    parts = F.split("path", "/")
    ends = files.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))).alias("suffix"))
    lone = ends.groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    return lone.groupBy("path").agg(F.min_by("suffix", F.length("suffix")).alias("suffix"))
