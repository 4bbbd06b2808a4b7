"""Journals of late changes, manifests, and batches of facts that are dealt, sorted and merged."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.repair import changed_paths

#: Facts and bytes that a batch holds at most.
BATCH_FACTS, BATCH_BYTES = 4096, 1 << 20


def accepts(path: Column, extensions: tuple[str, ...], out: str, ignored: tuple[str, ...] = ()) -> Column:
    """ST2: whether a change counts: a known extension, not below the output or an ignored folder."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    inside = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(out, *ignored))
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*extensions) & ~inside


def queue(paths: DataFrame, journal: str) -> None:
    """ST3: appends (path, ord) that came during a rebuild; a file of its own each time, so that nothing is lost by a failure."""
    paths.select("path", "ord").write.mode("append").parquet(journal)


def drain(spark: SparkSession, journal: str) -> DataFrame:
    """ST4: (path, ord): what is queued, each path once in the order it came; the journal is empty from then on.

    The journal is moved away first, so that changes that come meanwhile begin a new one.
    """
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(journal)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(source):
        return spark.createDataFrame([], "path string, ord long")
    taken = f"{journal}-taken-{uuid.uuid4().hex}"
    if not fs.rename(source, jvm.org.apache.hadoop.fs.Path(taken)):
        raise OSError(f"{journal} can't be moved")
    return changed_paths(spark.read.parquet(taken))


def save_manifest(state: DataFrame, folder: str, number: int) -> None:
    """SRC17: states (path, mtime, hash) as version number; readers see complete versions only."""
    state.select("path", "mtime", "hash").write.mode("overwrite").parquet(f"{folder}/v={number}")


def load_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """SRC16: the last complete version of a manifest, or an empty one."""
    found = complete_versions(spark, folder)
    return spark.read.parquet(f"{folder}/v={found[-1]}") if found else spark.createDataFrame([], "path string, mtime long, hash string")


def complete_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions below a folder, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    kids = [f.getPath() for f in fs.listStatus(path)]
    return sorted(int(k.getName()[2:]) for k in kids if k.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(k, "_SUCCESS")))


def split_facts(facts: DataFrame, source: str, order: str, size: Column, most: int = BATCH_FACTS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """ST12: facts with their batch within their source, of at most so many facts and about so many bytes.

    A batch ends where the bytes or facts before a row pass a whole number of limits, so that a
    batch's bytes are below the limit plus one fact.
    """
    w = Window.partitionBy(source).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.greatest(F.floor((F.row_number().over(w) - 1) / most), F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / most_bytes))
    return facts.withColumn("batch", step.cast("long")).withColumn("batch", (F.dense_rank().over(Window.partitionBy(source).orderBy("batch")) - 1).cast("long"))


def duplicate_batches(batches: DataFrame) -> DataFrame:
    """TOP12: (source_ord, batch_ord, n) of keys that come more than once, which sorting refuses."""
    return batches.groupBy("source_ord", "batch_ord").agg(F.count("*").alias("n")).where("n > 1")


def sorted_batches(runs: list[DataFrame]) -> DataFrame:
    """TOP12, TOP13, ST15: the batches of sorted runs as one, by source and batch: a range exchange and a sort, which spills."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.orderBy("source_ord", "batch_ord")


def compact(spark: SparkSession, folder: str, number: int) -> None:
    """ST14: all complete runs below a folder as the one run number, sorted; older runs stay for their readers."""
    found = complete_versions(spark, folder)
    if found:
        sorted_batches([spark.read.parquet(f"{folder}/v={n}") for n in found]).write.mode("overwrite").parquet(f"{folder}/v={number}")
