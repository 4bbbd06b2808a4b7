"""Graphs handed to a single Python worker, for walks in which each step depends on the one before.

Arcs arrive in order and are kept in files that are mapped into memory, so that a graph need not
fit in the worker's memory; nothing passes through the driver but a few numbers a partition.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that a worker gives back.
ROWS = 1 << 16
#: monotonically_increasing_id counts within a partition in so many bits.
_BITS = 33


def numbered(rows: DataFrame, by: str, keep) -> tuple[DataFrame, int]:
    """The rows with num, their place in the order of the distinct values by, from 0 on without gaps; and how many.

    keep: writes a table and gives it back.
    """
    sparse = keep(rows.orderBy(by).withColumn("num", F.monotonically_increasing_id()))
    counts = {r.p: r.n for r in sparse.groupBy(F.shiftright("num", _BITS).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, {}
    for p in sorted(counts):
        starts[p] = before - (p << _BITS)
        before += counts[p]
    if not starts:
        return sparse, 0
    shift = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), F.shiftright("num", _BITS).cast("long"))
    return sparse.withColumn("num", F.col("num") + shift), before


class Arcs:
    """Arcs of (node, other, ...) batches in the order of node, as arrays in files of a folder."""

    def __init__(self, folder: str, kinds: dict[str, str]):
        self.folder, self.kinds = folder, kinds
        self.files = {name: open(f"{folder}/{name}", "wb") for name in kinds}

    def add(self, **columns: np.ndarray) -> None:
        for name, values in columns.items():
            values.astype(self.kinds[name], copy=False).tofile(self.files[name])

    def arrays(self) -> dict[str, np.ndarray]:
        """The columns, mapped into memory."""
        out = {}
        for name, kind in self.kinds.items():
            self.files[name].close()
            path = f"{self.folder}/{name}"
            out[name] = np.memmap(path, kind, "r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, kind)
        return out


def rows(names: list[str], arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Columns of longs as batches."""
    for i in range(0, len(arrays[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + ROWS], pa.int64()) for a in arrays], names=names)
