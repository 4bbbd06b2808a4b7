"""Exact dedup by 128-bit content hash, with a comparison of the bytes inside groups.

Only hashes and ids are shuffled for all documents.  The texts themselves move only for hashes
that more than one document has, once a distinct text and map task, to prove that a hash stands
for a single text.  If it ever stands for several, groups are made by the text itself.

Defined results: a null text counts as an empty one.  Null ids are smaller than any id.  Of
repeated rows with the same id and text one stays; which of them can't be told apart.  An empty
table gives an empty table.  Extra input columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, small, split_join, strip_to


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash128: Callable[[Column], Column] = content_hash,
    digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256),
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row; keep: the "min" or "max" id stays.

    hash128 and digest can be given so that tests can force collisions.
    """
    scratch = Scratch(docs.sparkSession)
    texts = strip_to(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    narrow = scratch.save(
        texts.select("id", F.monotonically_increasing_id().alias("uid"), hash128(F.col("text")).alias("h"), digest(F.col("text")).alias("sha"), F.sha2("text", 256).alias("text_sha256")),
        "narrow",
    )
    shared_hash = scratch.save(narrow.groupBy("h").count().where("count > 1").select("h"), "shared_hash")
    several = texts.select(hash128(F.col("text")).alias("h"), digest(F.col("text")).alias("sha"), "text").join(small(scratch, "shared_hash", shared_hash), "h", "left_semi")
    # A distinct of (hash, text) compares bytes, and keeps one copy of a text in each map task.
    clash = several.distinct().groupBy("h", "sha").count().where("count > 1").limit(1).count()
    if clash:
        return _by_text(texts, id_col, keep)
    # Documents of one hash that differ in the second digest are collisions, too: both are the key.
    return _finish(narrow, ["h", "sha"], id_col, keep)


def _by_text(texts: DataFrame, id_col: str, keep: str) -> DataFrame:
    keyed = Scratch(texts.sparkSession).save(texts.select("id", F.monotonically_increasing_id().alias("uid"), "text", F.sha2("text", 256).alias("text_sha256")), "by_text")
    return _finish(keyed, ["text"], id_col, keep)


def _finish(keyed: DataFrame, key: list[str], id_col: str, keep: str) -> DataFrame:
    order = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), (-F.col("uid")).alias("first"))
    if keep == "max":
        chosen = F.max(order)
    elif keep == "min":
        chosen = F.min(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("uid").alias("first")))
    else:
        raise ValueError(f"keep must be min or max, not {keep!r}")
    classes = keyed.groupBy(*key).agg(F.count("*").alias("group_size"), chosen.alias("best"))
    out = split_join(keyed, classes, key)
    first = -F.col("best.first") if keep == "max" else F.col("best.first")
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == first).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    One row of each text stays, that of the smallest (or largest) id; of repeated rows one.
    """
    scratch = Scratch(docs.sparkSession)
    pair = [F.col(id_col).alias("_key"), F.col("text_sha256").alias("_sha")]
    # Rows of one id and text share their fate, but for one that stays of several.
    fates = groups(docs, id_col, text_col, keep).groupBy(*pair).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    fates = scratch.save(fates.where("not stays or n > 1"), "fates")
    dropped = scratch.save(fates.where("not stays").select("_key", "_sha"), "dropped")
    again = scratch.save(fates.where("stays").select("_key", "_sha"), "again")
    keyed = docs.withColumns({"_sha": F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256), "_key": F.col(f"`{id_col}`")})
    rest = _match(keyed, small(scratch, "dropped", dropped), "left_anti")
    if again.limit(1).count():
        again = small(scratch, "again", again)
        rest = _match(rest, again, "left_anti").unionByName(_match(keyed, again, "left_semi").dropDuplicates(["_key", "_sha"]))
    return rest.drop("_key", "_sha")


def _match(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.select(F.col("_key").alias("_rk"), F.col("_sha").alias("_rs"))
    return left.join(right, (F.col("_sha") == F.col("_rs")) & F.col("_key").eqNullSafe(F.col("_rk")), how)
