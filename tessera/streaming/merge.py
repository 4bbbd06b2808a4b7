"""Structured Streaming of fact batches into a graph table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.model import cut
from tessera.operators.sets import keep_one, replace_by_source
from tessera.streaming.journal import complete_versions


#: Parts of the state; a micro-batch writes those that its sources are in.
BUCKETS = 64


def merge_stream(spark: SparkSession, source: str, schema: StructType, state: str, checkpoint: str, fmt: str = "parquet") -> None:
    """ST1, ST5, ST6: reads what has arrived in source and merges it into the state, file by file.

    Each micro-batch holds whole sources: their facts replace those of an earlier batch.  A batch
    writes only the buckets of its sources, under its own number, so that doing it again, after a
    failure, gives the same table; readers see each bucket's last complete version.  The state keeps
    the number of buckets that it began with.
    """

    def apply(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS))
        fresh = cut(keep_one(batch, ["source_file", "tier", "id"], F.col("ord"), last=True))
        touched = [r.b for r in fresh.select(bucket.alias("b")).distinct().collect()]  # BUCKETS rows at most
        paths = _buckets(spark, state, number)
        old = [paths[b] for b in touched if b in paths]
        merged = replace_by_source(spark.read.schema(schema).parquet(*old), fresh) if old else fresh
        merged.withColumn("b", bucket).repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{state}/v={number}")

    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", 1).load(source)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _buckets(spark: SparkSession, state: str, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket's last complete version, or the last one before a number."""
    jvm = spark.sparkContext._jvm
    out: dict[int, str] = {}
    for n in complete_versions(spark, state):
        if before is None or n < before:
            path = jvm.org.apache.hadoop.fs.Path(f"{state}/v={n}")
            for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
                name = f.getPath().getName()
                if name.startswith("b="):
                    out[int(name[2:])] = f"{state}/v={n}/{name}"
    return out


def latest(spark: SparkSession, state: str, before: int | None = None) -> DataFrame | None:
    """The state as it is, or as it was before a number."""
    paths = _buckets(spark, state, before)
    return spark.read.parquet(*sorted(paths.values())) if paths else None


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An addition to the batch operators: events by kind and window of event time, late ones within the watermark."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    counts = marked.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), kind, "n", F.round("total", 6).alias("total"))
