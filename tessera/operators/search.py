"""Ranked search over nodes: term weights, tiers, seeds and trigram postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import query_terms, search_text_udf, shingles
from tessera.model import PropertyGraph
from tessera.operators.measures import degrees

# What a hit is worth.
EXACT, PREFIX, SUBSTRING, SOURCE = 1000.0, 100.0, 1.0, 0.5
#: A whole-question hit is worth so many times a term's.
WHOLE = 10.0


def searchable(g: PropertyGraph, ascii_labels: bool = False) -> DataFrame:
    """Nodes with the texts that searches look at; ascii_labels spares the Unicode normalizer."""
    norm = F.lower("label") if ascii_labels else search_text_udf("label")
    n = g.nodes.withColumn("norm", norm)
    tokens = F.trim(F.regexp_replace("norm", r"[^_\p{IsAlphabetic}\p{N}]+", " "))
    return n.select("id", "label", "source_file", "node_ord", "norm", F.regexp_replace("norm", r"(\(\))+$", "").alias("bare"), tokens.alias("tokens"), F.lower("source_file").alias("source"), F.lower("id").alias("low_id"))


def term_weights(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """FN10: (term, df, idf) with idf = ln(1 + N / (1 + df)); df counts labels that contain the term."""
    counts = nodes.agg(F.count("*").alias("n"), *[F.count_if(F.contains("norm", F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)])
    spread = counts.select("n", F.explode(rows).alias("x")).select("n", "x.term", "x.df")
    return spread.select("term", F.col("df").cast("long"), F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


def _weights(nodes: DataFrame, terms: list[str]) -> dict[str, float]:
    """One number a term of the question."""
    return {r.term: r.idf for r in term_weights(nodes, terms).collect()}


def _hit(term: str, weight: float) -> tuple[Column, Column, Column]:
    """(exact or prefix, substring, source) values of a term."""
    t = F.lit(term)
    exact = (F.col("norm") == t) | (F.col("bare") == t)
    start = F.startswith("norm", t) | F.startswith("bare", t)
    tier = F.when(exact, EXACT * weight).when(start, PREFIX * weight).otherwise(0.0)
    inner = F.when(~exact & ~start & F.contains("norm", t), SUBSTRING * weight).otherwise(0.0)
    return tier, inner, F.when(F.contains("source", t), SOURCE * weight).otherwise(0.0)


def _whole(text: str, weight: float) -> Column:
    t = F.lit(text)
    same = (F.col("norm") == t) | (F.col("bare") == t) | (F.col("tokens") == t) | (F.col("low_id") == t)
    start = F.startswith("norm", t) | F.startswith("bare", t) | F.startswith("tokens", t)
    return F.when(same, EXACT * WHOLE * weight).when(start, PREFIX * WHOLE * weight).otherwise(0.0)


def score_nodes(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """GR4, TOP3: (id, label, norm, node_ord, score) of nodes that score, one pass over the nodes.

    The question has a bounded number of terms, so each is an expression rather than a joined row.
    """
    if not terms:
        return nodes.select("id", "label", "norm", "node_ord", F.lit(0.0).alias("score")).limit(0)
    idf = _weights(nodes, terms)
    hits = [_hit(t, idf[t]) for t in terms]
    matched = sum((((a > 0) | (b > 0)).cast("int") for a, b, _ in hits[1:]), ((hits[0][0] > 0) | (hits[0][1] > 0)).cast("int"))
    tiers = sum((a for a, _, _ in hits[1:]), hits[0][0])
    loose = sum((b + c for _, b, c in hits[1:]), hits[0][1] + hits[0][2])
    score = _whole(" ".join(terms), max(1.0, *idf.values())) + loose + tiers * F.pow(matched / len(terms), F.lit(2.0))
    return nodes.withColumn("score", score).where("score > 0").select("id", "label", "norm", "node_ord", "score")


def ranked(scored: DataFrame) -> list[Column]:
    return [F.desc("score"), F.length("label"), F.col("id")]


def best_seed_per_term(g: PropertyGraph, nodes: DataFrame, terms: list[str]) -> DataFrame:
    """WIN1: (term, id, score): each term's best node by its own score, degree, label length and id."""
    idf = _weights(nodes, terms)
    rows = []
    for t in terms:
        tier, inner, source = _hit(t, idf[t])
        rows.append(F.struct(F.lit(t).alias("term"), (_whole(t, idf[t]) + tier + inner + source).alias("score")))
    spread = nodes.select("id", "label", F.explode(F.array(*rows)).alias("x")).select("id", "label", "x.term", "x.score").where("score > 0")
    spread = spread.join(degrees(g), "id")
    order = F.struct(-F.col("score"), -F.col("degree"), F.length("label"), F.col("id"))
    return spread.groupBy("term").agg(F.min_by(F.struct("id", "score"), order).alias("b")).select("term", "b.id", F.round("b.score", 6).alias("score"))


def pick_seeds(g: PropertyGraph, question: str, most: int = 3, gap: float = 0.2, ascii_labels: bool = False) -> DataFrame:
    """TOP4: (rank, id): up to `most` best nodes of different labels above gap times the best, then each term's own best."""
    terms = query_terms(question)
    nodes = searchable(g, ascii_labels)
    scored = score_nodes(nodes, terms)
    # The first of each label stands for it, so that the best ones are few rows.
    order = F.struct(-F.col("score"), F.length("label"), F.col("id"))
    firsts = scored.groupBy("norm").agg(F.min(F.struct((-F.col("score")).alias("s"), F.length("label").alias("n"), "id")).alias("b"), F.min_by("score", order).alias("score"))
    top = firsts.orderBy("b").limit(most).select("norm", "score", "b.id").collect()
    limit = top[0].score * gap if top else 0.0
    chosen = [(r.norm, r.id) for r in top if r.score >= limit]
    taken = {n for n, _ in chosen}
    if terms:
        own = best_seed_per_term(g, nodes, terms).join(nodes.select("id", "norm"), "id").orderBy("term").collect()
        for r in own:
            if r.norm not in taken:
                taken.add(r.norm)
                chosen.append((r.norm, r.id))
    return g.nodes.sparkSession.createDataFrame([(i, x) for i, (_, x) in enumerate(chosen)], "rank long, id string")


def find_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """GR12: (id, tier) of nodes that a name means: its file (0), its label (1), a start (2) or part (3) of it."""
    q = query.lower().strip()
    t = F.lit(q)
    tier = (
        F.when(F.col("source") == t, 0).when((F.col("norm") == t) | (F.col("bare") == t) | (F.col("tokens") == t) | (F.col("low_id") == t), 1)
        .when(F.startswith("norm", t) | F.startswith("bare", t), 2).when(F.contains("norm", t), 3)
    )
    return nodes.withColumn("tier", tier.cast("long")).where("tier is not null").select("id", "tier")


def trigrams(nodes: DataFrame) -> DataFrame:
    """FN8, FN9: postings (gram, id) of labels."""
    return nodes.select("id", F.explode(shingles(F.col("norm"), 3)).alias("gram"))


def trigram_candidates(nodes: DataFrame, needle: str) -> DataFrame:
    """GR5: ids whose postings hold every gram of the needle: all that contain it, and a few more."""
    grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)}) or [needle]
    held = trigrams(nodes).where(F.col("gram").isin(*grams))
    return held.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def window_rank(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
