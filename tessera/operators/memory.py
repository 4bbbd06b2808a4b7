"""Work memory: decayed scores of cited nodes, lessons, and pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import decay
from tessera.operators.sets import keep_one

# Conclusions of checks that fail, and states of ones that run.
FAILED = ("FAILURE", "CANCELLED", "TIMED_OUT", "ACTION_REQUIRED", "STARTUP_FAILURE")
RUNNING = ("IN_PROGRESS", "QUEUED")
STALE_DAYS, HALF_LIFE, CORROBORATION = 14, 30.0, 2


def cited(docs: DataFrame) -> DataFrame:
    """One row for each node that a document cites, however often."""
    return docs.select("doc", "date", "question", "outcome", "age", F.explode(F.array_distinct("source_nodes")).alias("node"))


def sign(outcome: Column) -> Column:
    return F.when(outcome == "useful", 1).when(outcome.isin("dead_end", "corrected"), -1).otherwise(0)


def scores(docs: DataFrame, half_life: float = HALF_LIFE) -> DataFrame:
    """AGG14: (node, score, pos, neg): outcomes of documents that cite a node, each half as strong a half-life ago."""
    c = cited(docs).withColumn("sign", sign(F.col("outcome"))).where("sign <> 0")
    return c.groupBy("node").agg(F.round(F.sum(F.col("sign") * decay(F.col("age"), half_life)), 9).alias("score"), F.count_if(F.col("sign") > 0).alias("pos"), F.count_if(F.col("sign") < 0).alias("neg"))


def buckets(scored: DataFrame, least: int = CORROBORATION) -> DataFrame:
    """AGG16: (node, bucket, verdict, score): preferred, tentative or contested; nodes with bad outcomes only are left out."""
    bucket = F.when((F.col("pos") > 0) & (F.col("neg") > 0), "contested").when(F.col("pos") >= least, "preferred").when(F.col("pos") > 0, "tentative")
    verdict = F.when(bucket == "contested", F.when(F.col("score") > 0, "useful").when(F.col("score") < 0, "dead end").otherwise("even"))
    return scored.select("node", bucket.alias("bucket"), verdict.alias("verdict"), "score").where("bucket is not null")


def outcome_counts(docs: DataFrame) -> DataFrame:
    """AGG13: (outcome, n)."""
    return docs.groupBy(F.coalesce("outcome", F.lit("unmarked")).alias("outcome")).agg(F.count("*").alias("n"))


def majority_community(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """AGG15: (doc, community): the community most cited nodes are in, ties by name, else Uncategorized."""
    c = cited(docs).join(nodes.where("community is not null").select(F.col("id").alias("node"), F.col("community").cast("string").alias("c")), "node")
    best = c.groupBy("doc", "c").agg(F.count("*").alias("n")).groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("k"), "c")).alias("b"))
    return docs.select("doc").join(best, "doc", "left").select("doc", F.coalesce("b.c", F.lit("Uncategorized")).alias("community"))


def provenance(docs: DataFrame, top: int = 5) -> DataFrame:
    """WIN11: (node, rank, date, question) of the latest documents that were useful or corrected."""
    c = cited(docs).where(F.col("outcome").isin("useful", "corrected"))
    latest = c.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("date", "question")), asc=False), 1, top).alias("l"))
    return latest.select("node", F.posexplode("l").alias("rank", "x")).select("node", F.col("rank").cast("long"), "x.date", "x.question")


def latest_dead_ends(docs: DataFrame) -> DataFrame:
    """WIN10: (question, date, doc): the last dead end of each question, by load order."""
    return keep_one(docs.where("outcome = 'dead_end'").select("question", "date", "doc"), ["question"], F.col("doc"), True)


def ci_status(checks: Column) -> Column:
    """AGG25: FAILURE before PENDING before SUCCESS of an array of (status, conclusion), or NONE."""
    any_ = lambda f: F.coalesce(F.exists(checks, f), F.lit(False))
    return (
        F.when(any_(lambda c: F.coalesce(c["conclusion"].isin(*FAILED), F.lit(False))), "FAILURE")
        .when(any_(lambda c: F.coalesce(c["status"].isin(*RUNNING), F.lit(False))), "PENDING")
        .when(any_(lambda c: F.coalesce(c["conclusion"] == "SUCCESS", F.lit(False))), "SUCCESS").otherwise("NONE")
    )


def pr_status(base: str, base_branch: Column, ci: Column, review: Column, draft: Column, days: Column) -> Column:
    """FN40: the first that holds of wrong base, failure, changes asked for, draft, stale, approved, pending; else ready."""
    return (
        F.when(base_branch != base, "WRONG-BASE").when(ci == "FAILURE", "CI-FAIL").when(review == "CHANGES_REQUESTED", "CHANGES-REQ").when(draft, "DRAFT")
        .when(days >= STALE_DAYS, "STALE").when(review == "APPROVED", "APPROVED").when(ci == "PENDING", "PENDING").otherwise("READY")
    )


def pr_impact(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN16, AGG8: (pr, communities, nodes): what is in the files that a pull request changes.

    A file matches a node's if they are equal or one ends with the other after a slash.  Every end
    of both paths is a key, so that the match is an equi-join: a whole path with an end of the other.
    """
    files = nodes.where("source_file <> ''").groupBy("source_file").agg(F.count("*").alias("n"), F.collect_set("community").alias("cs"))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), -k, k), "/"))
    ch = changes.select("pr", F.replace(F.col("file"), F.lit("\\"), F.lit("/")).alias("file")).distinct()
    whole = ch.join(files.select("source_file", F.explode(ends(F.col("source_file"))).alias("file")), "file").select("pr", "source_file")
    part = ch.select("pr", F.explode(ends(F.col("file"))).alias("source_file")).join(files.select("source_file"), "source_file").select("pr", "source_file")
    met = whole.union(part).distinct().join(files, "source_file")
    return met.groupBy("pr").agg(F.array_join(F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cs")))), lambda x: x.cast("string")), ",").alias("communities"), F.sum("n").alias("nodes"))
