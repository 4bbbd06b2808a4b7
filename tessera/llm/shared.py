"""Tables in the cluster's shared folder, bounded broadcasts and joins that skew handling can split."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a broadcast table may have at most; larger sides are shuffled instead.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (tests) an own one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder.  They cut lineage and survive lost executors.

    Saving under a name again removes the older table, once the new one is written.

    drop() removes a table that no later plan reads.  Tables that a returned DataFrame still
    reads stay, as checkpoint files do.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{self.count}"
        self.count += 1
        df.write.mode("overwrite").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.paths.pop(name, None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop_all(self, but: tuple[str, ...] = ()) -> None:
        """Removes all tables but the named ones."""
        for name in [n for n in self.paths if n not in but]:
            self.drop(name)

    def bytes_of(self, name: str) -> int:
        """Size of a saved table on disk."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.paths[name])
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(target).getLength()


def small(scratch: Scratch, name: str, df: DataFrame, limit: int = BROADCAST_BYTES, width: int = 4) -> DataFrame:
    """The saved table, with a broadcast hint if its size on disk times width is within the limit.

    width allows for what Parquet's encodings save.  A larger table is returned without a hint,
    so that the join shuffles both sides.
    """
    return F.broadcast(df) if scratch.bytes_of(name) * width <= limit else df


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join (nulls equal nulls) whose sides both get an exchange of their own.

    The exchange is on a hash of the key, which no earlier aggregate has as its partitioning; so
    adaptive execution can split a key that holds many rows of one side.
    """
    key = lambda: F.xxhash64(*[F.col(c) for c in on])
    lft = left.withColumn("_hk", key())
    rgt = right.withColumn("_hk", key())
    for c in on:
        rgt = rgt.withColumnRenamed(c, f"_r_{c}")
    rgt = rgt.withColumnRenamed("_hk", "_r_hk")
    cond = F.col("_hk") == F.col("_r_hk")
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    out = lft.join(rgt, cond, how)
    return out.drop("_hk", "_r_hk", *[f"_r_{c}" for c in on])


def strip_to(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names; other columns can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


#: Bytes of an Arrow batch, from which on it is sent although it has fewer rows.
BATCH_BYTES = 16 << 20


def workers(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows and about BATCH_BYTES from now on, so that long texts fit in a worker's memory.

    A returned DataFrame runs later, so that the setting has to stay for the session; it is only
    ever lowered.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(name)) or 0) if "-" not in spark.conf.get(name) else 0
        if now > most or now <= 0:
            spark.conf.set(name, str(most))
