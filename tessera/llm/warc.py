"""Fixity audit of WARC archives with Merkle trees.

Each record has a SHA-256 and a place (offset and length) in its archive.  Records of an offset
range are hashed in order into a leaf, FANOUT neighbouring leaves into a node, and so on up to one
root an archive.  Two replicas are compared root by root; only the children of nodes that differ are
compared further, down to the records of ranges that differ.

Defined results: archives, ranges or records that one replica lacks count as differing.  Records
that repeat with the same place and hash are counted, and differ if the counts do.  A null payload
is an empty one.  An empty replica makes every record missing or extra.  Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import BATCH_BYTES, Scratch, strip_to, workers

#: Bytes of an archive in a leaf: it holds at most so many records of one byte.
RANGE = 1 << 16
#: Children of a node.
FANOUT = 16
#: Pages packed in one archive.
PAGES = 512
#: Packed bytes that are unpacked at once.
STEP = 1 << 20
#: The type of the row that stands for the unreadable end of a packed file.
DAMAGED = "damaged"


def record_bytes(url: Column, payload: Column) -> Column:
    """A WARC resource record as bytes."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def pack(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", per: int = PAGES, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, archive, offset, length, sha256) of every page and the columns in also, in archives of about per pages.

    An archive holds neighbouring ids in order, then by URL and hash.  Pages without an id go to
    archives below zero by their URL and hash.  Only places and hashes are shuffled.
    """
    rows = strip_to(pages, id=id_col, url=url_col, payload=payload_col, **{f"also_{c}": c for c in also})
    record = record_bytes(F.col("url"), F.col("payload"))
    narrow = rows.select("id", "url", *[f"also_{c}" for c in also], F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha256"))
    loose = -1 - F.pmod(F.xxhash64("url", "sha256"), F.lit(1 << 16))
    narrow = narrow.withColumn("archive", F.coalesce(F.floor(F.col("id") / per), loose))
    order = Window.partitionBy("archive").orderBy("id", "url", "sha256").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return narrow.select("id", "archive", (F.sum("length").over(order) - F.col("length")).alias("offset"), "length", "sha256", *[F.col(f"also_{c}").alias(c) for c in also])


def unpacked(data: bytes) -> tuple[bytes, bool]:
    """The bytes of all gzip members, or data itself if it isn't packed, and whether all could be read."""
    if data[:2] != b"\x1f\x8b":
        return data, True
    out, left = [], data
    while left:
        member = zlib.decompressobj(31)
        try:
            for at in range(0, len(left), STEP):
                out.append(member.decompress(left[at : at + STEP]))
                if member.eof:
                    left = member.unused_data + left[at + STEP :]
                    break
            else:
                return b"".join(out), False
        except zlib.error:
            return b"".join(out), False
        if not left.strip(b"\0"):
            break
    return b"".join(out), True


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, payload) of each record of unpacked bytes."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        lines = data[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else 0
        body = data[end + 4 : end + 4 + size]
        at = min(len(data), end + 4 + size + 4)
        yield start, at - start, headers, body


def read(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, length, warc_type, url, payload, sha256) of the records in WARC files.

    A file is read as one binary value, so that it must be below 2 GB and fit in a worker; files come
    one by one and records go in batches of bounded bytes.  Of a packed file that is damaged, the
    records before the damage come, and a last row of type DAMAGED without URL, payload and hash at
    the offset up to which it could be unpacked.
    """
    workers(spark, 1)
    names = ["archive", "offset", "length", "warc_type", "url", "payload", "sha256"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                plain, whole = unpacked(content.as_py())
                rows, filled = [], 0
                for o, n, h, body in parse(plain):
                    rows.append((file, o, n, h.get("warc-type"), h.get("warc-target-uri"), body, hashlib.sha256(plain[o : o + n]).hexdigest()))
                    filled += len(body)
                    if filled > BATCH_BYTES:
                        yield batch(rows)
                        rows, filled = [], 0
                if not whole:
                    rows.append((file, len(plain), 0, DAMAGED, None, None, None))
                yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, offset long, length long, warc_type string, url string, payload binary, sha256 string")


def _ordered_hash(place: str, text: Column) -> Column:
    """SHA-256 of a group's lines in the order of place; groups are bounded by RANGE and FANOUT."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(place), text.alias("line"))))
    return F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256)


def tree(records: DataFrame, levels: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables (archive, node, hash), the leaves first."""
    counted = records.groupBy("archive", "offset", "length", "sha256").agg(F.count("*").alias("n"))
    line = F.concat_ws(" ", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("sha256"), F.col("n").cast("string"))
    leaves = counted.withColumn("node", F.floor(F.col("offset") / RANGE)).withColumn("line", line)
    now = scratch.save(leaves.groupBy("archive", "node").agg(_ordered_hash("offset", F.col("line")).alias("hash")), f"{name}0")
    out = [now]
    for level in range(1, levels):
        up = now.withColumn("line", F.concat_ws(" ", F.col("node").cast("string"), F.col("hash"))).withColumn("up", F.floor(F.col("node") / FANOUT))
        now = scratch.save(up.groupBy("archive", "up").agg(_ordered_hash("node", F.col("line")).alias("hash")).withColumnRenamed("up", "node"), f"{name}{level}")
        out.append(now)
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, node) whose hashes differ or that one side lacks."""
    b = b.withColumnRenamed("hash", "other")
    return a.join(b, ["archive", "node"], "full_outer").where(~F.col("hash").eqNullSafe(F.col("other"))).select("archive", "node")


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """(archive, offset, length, sha256, replica_length, replica_sha256, status) of records that differ.

    Both have archive, offset, length and sha256.  status: corrupt (the place holds something else),
    missing (the replica lacks it), extra (only the replica has it) or repeated (the counts differ).
    """
    scratch = Scratch(original.sparkSession)
    cols = {c: c for c in ("archive", "offset", "length", "sha256")}
    original, replica = strip_to(original, **cols), strip_to(replica, **cols)
    ends = [d.agg(F.max("offset")).first()[0] or 0 for d in (original, replica)]
    nodes, levels = max(ends) // RANGE + 1, 1
    while nodes > 1:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    a, b = tree(original, levels, scratch, "a"), tree(replica, levels, scratch, "b")
    bad = _differ(a[-1], b[-1])
    for level in range(levels - 2, -1, -1):
        parents = bad.select(F.col("archive").alias("pa"), F.col("node").alias("pn"))
        inside = lambda t: t.join(parents, (F.col("archive") == F.col("pa")) & (F.floor(F.col("node") / FANOUT) == F.col("pn")), "left_semi")  # noqa: E731, B023
        # Each level is saved, as both replicas read it at the next one.
        bad = scratch.save(_differ(inside(a[level]), inside(b[level])), f"bad{level}")
    bad = scratch.save(bad, "bad").select(F.col("archive").alias("pa"), F.col("node").alias("pn"))

    def within(records: DataFrame) -> DataFrame:
        here = records.join(bad, (F.col("archive") == F.col("pa")) & (F.floor(F.col("offset") / RANGE) == F.col("pn")), "left_semi")
        return here.groupBy("archive", "offset", "length", "sha256").agg(F.count("*").alias("n"))

    left, right = within(original), within(replica)
    same = ["archive", "offset", "length", "sha256"]
    agreed = left.join(right.withColumnRenamed("n", "m"), same)
    repeated = agreed.where("n <> m").select(*same, F.col("length").alias("replica_length"), F.col("sha256").alias("replica_sha256"), F.lit("repeated").alias("status"))
    lone = left.join(right, same, "left_anti").drop("n")
    odd = right.join(left, same, "left_anti").select("archive", "offset", F.col("length").alias("replica_length"), F.col("sha256").alias("replica_sha256"))
    status = F.when(F.col("sha256").isNull(), "extra").when(F.col("replica_sha256").isNull(), "missing").otherwise("corrupt")
    return lone.join(odd, ["archive", "offset"], "full_outer").withColumn("status", status).select(*repeated.columns).unionByName(repeated)


def fixity(pages: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, archive, offset, length, sha256, replica_sha256, status) of every page and every extra record.

    replica: archive, offset, length, sha256.  status is ok for records that agree.
    """
    scratch = Scratch(pages.sparkSession)
    own = scratch.save(pack(pages, id_col, url_col, payload_col), "own")
    found = scratch.save(audit(own, replica), "found")
    place = ["archive", "offset", "length", "sha256"]
    known = found.where("status <> 'extra'").select(*place, "replica_sha256", "status").dropDuplicates(place)
    judged = own.join(known, place, "left").withColumn("replica_sha256", F.when(F.col("status").isNull(), F.col("sha256")).otherwise(F.col("replica_sha256")))
    judged = judged.withColumn("status", F.coalesce("status", F.lit("ok"))).withColumnRenamed("id", id_col).select(id_col, *place, "replica_sha256", "status")
    extra = found.where("status = 'extra'").select(F.lit(None).cast(own.schema["id"].dataType).alias(id_col), "archive", "offset", F.col("replica_length").alias("length"), "sha256", "replica_sha256", "status")
    return judged.unionByName(extra)
