"""URL rules by host suffix and path prefix.

Each distinct (host, path) is expanded into expressions, a host suffix followed by a path prefix.
Expressions meet rules in an equi-join on a short prefix of their SHA-256; the full digest then
confirms the match, and the longest rule decides.

Defined results: a null URL or one without "://" has an empty host and path and fits no rule.
Hosts are compared after A-Z is lower-cased and nothing else; a port or user name is part of the
host.  Of rules of equal length the one with the longer host wins, then block before allow.
Repeated rows are judged alike, each kept.  Extra input columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import split_join, strip_to

#: Hexadecimal digits of the digest that the equi-join compares first (32 bits).
PREFIX_HEX = 8
#: So many rules (about 200 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # "allow" or "block"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_host, rule_path, rule, verdict) of a list of rules."""
    rows = [(r.host.translate(str.maketrans(_UPPER, _LOWER)), r.path, r.verdict) for r in rules]
    table = spark.createDataFrame(rows, "rule_host string, rule_path string, verdict string")
    return table.withColumn("rule", F.concat("rule_host", "rule_path"))


def _expression(host: Column, path: Column) -> Column:
    # Hosts hold no "/", so that a slash ends the host unambiguously.
    return F.concat(host, F.lit("/"), path)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages.

    rules: rule_host, rule_path (from its first slash on), rule, verdict.  The lengths that rule
    paths have are gathered on the driver: at most as many numbers as there are lengths.
    """
    rows = strip_to(pages, **{"_id": id_col, "_url": url_col}).select("_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    rules = rules.dropDuplicates(["rule_host", "rule_path", "verdict"]).select("rule_host", "rule_path", "rule", "verdict", F.sha2(_expression(F.col("rule_host"), F.col("rule_path")), 256).alias("rule_digest"))
    known = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    rules = rules.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    if known["n"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    urls = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in known["lengths"]]) if known["lengths"] else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    spread = urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    digests = spread.select("host", "path", F.sha2(_expression(F.col("suffix"), F.col("prefix")), 256).alias("digest"))
    digests = digests.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    met = digests.join(rules, "short").where(F.col("digest") == F.col("rule_digest"))
    order = F.struct(F.length("rule"), F.length("rule_host"), (F.col("verdict") == "block").cast("int"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    out = split_join(rows, best, ["host", "path"], "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
