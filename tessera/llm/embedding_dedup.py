"""Embedding near-dedup by an epsilon grid order join.

Unit vectors within a cosine c of each other are within eps = sqrt(2 - 2c).  Vectors are sorted by
the grid cells, eps wide, of their leading principal coordinates; the order is cut into blocks, and
blocks into intervals of FAN blocks, intervals of intervals, and so on.  Pairs of intervals are
joined from the top down, and a pair whose bounding boxes are farther apart than eps is skipped with
all that it holds.  Inside a pair of blocks the same recursion goes on down to a few dozen vectors,
which are multiplied.

Equal vectors of a label are one class, so that copies never form pairs; a pair of blocks gives one
row for each of its vectors with a link, and a spanning forest of its links, never all pairs.

Defined results: vectors of other labels or lengths are never compared.  A null label links with
nothing, nor does a vector that is null, empty or zero or that holds a null or a value that isn't
finite.  Repeated rows are linked like other copies.  Null ids are in a component, but the smallest
id only if all are null.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import Scratch, split_join, strip_to

#: Classes of a block.
BLOCK = 512
#: Blocks or intervals of an interval above; a power of two.
FAN_BITS = 3
#: Classes below which a pair of intervals is multiplied.
LEAF = 64
#: Leading principal dimensions of the grid, and of the bounding boxes.
GRID, BOX = 4, 8
#: Added to the bounds that skip, so that rounding never loses a link.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrices(b: pa.RecordBatch, vec: int, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, unit vectors) of a batch, by vector length."""
    dims = b.column(dim).to_numpy(zero_copy_only=False)
    column = b.column(vec)
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield int(d), rows, _unit(flat.reshape(len(rows), d))


def principal(classes: DataFrame, k: int) -> dict[int, np.ndarray]:
    """For each vector length d the d x k leading principal directions of all unit vectors.

    The driver gets the sums of products, d * d numbers for each length.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(b, 0, 1):
                x = np.hstack((x, np.ones((len(x), 1))))
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            i, j = np.triu_indices(d + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["d", "i", "j", "s"])

    found = classes.select("vec", "dim").mapInArrow(sums, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for d, g in found.groupby("d"):
        m = np.zeros((d + 1, d + 1))
        m[g["i"], g["j"]] = g["s"]
        m = m + np.triu(m, 1).T
        n, mean = m[d, d], m[:d, d] / m[d, d]
        _, directions = np.linalg.eigh(m[:d, :d] / n - np.outer(mean, mean))
        out[int(d)] = directions[:, ::-1][:, :k]
    return out


def _gap2(lo_a, hi_a, lo_b, hi_b):
    """Squared distance of two boxes."""
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (gap * gap).sum(axis=-1)


class _Forest:
    """Union-find over the classes of two blocks."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def join_sequences(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, cosine: float, same: bool, emit) -> None:
    """Joins two intervals of the grid order by halving, and skips distant halves.

    px, py: principal coordinates.  emit(i, j) gets arrays of linked rows of x and y; for the same
    interval twice only i < j.
    """
    eps2 = 2 - 2 * cosine + SLACK

    def go(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and b1 <= a0:
            return
        if _gap2(px[a0:a1].min(axis=0), px[a0:a1].max(axis=0), py[b0:b1].min(axis=0), py[b0:b1].max(axis=0)) > eps2:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            i, j = np.nonzero(x[a0:a1] @ y[b0:b1].T >= cosine)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                emit(i, j)
            return
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        for s, t in ((a0, am), (am, a1)) if a1 - a0 > LEAF else ((a0, a1),):
            for u, v in ((b0, bm), (bm, b1)) if b1 - b0 > LEAF else ((b0, b1),):
                go(s, t, u, v)

    go(0, len(x), 0, len(y))


def _blocks(cells: DataFrame, boxes: int) -> DataFrame:
    """Runs of up to BLOCK classes of one label in grid order, each with its bounding box."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, index = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal index
            p = np.frombuffer(b"".join(t["p"].to_pylist()), dtype="<f8").reshape(len(t), boxes)
            row = {
                "label": t["label"][0].as_py(), "dim": t["dim"][0].as_py(), "part": part, "idx": index, "size": len(t),
                "cids": t["cid"].to_numpy().astype("<i8").tobytes(), "copies": t["copies"].to_numpy().astype("<i8").tobytes(),
                "x": b"".join(t["x"].to_pylist()), "p": p.tobytes(),
            } | {f"lo{i}": float(p[:, i].min()) for i in range(boxes)} | {f"hi{i}": float(p[:, i].max()) for i in range(boxes)}
            index += 1
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            t = pa.concat_tables(held)
            key = np.char.add(np.char.add(t["dim"].to_numpy().astype(str), "/"), np.array(t["label"].to_pylist(), dtype=str))
            ends = [*(np.flatnonzero(key[1:] != key[:-1]) + 1), len(t)]
            at = 0
            for e in ends:
                while e - at >= BLOCK or (e < len(t) and e > at):
                    yield block(t.slice(at, min(BLOCK, e - at)))
                    at = min(e, at + BLOCK)
            held = [t.slice(at)] if at < len(t) else []
        if held:
            yield block(held[0])

    label = cells.schema["label"].dataType.simpleString()
    floats = [f"{s}{i}" for s in ("lo", "hi") for i in range(boxes)]
    arrow = pa.schema(
        [("label", pa.string()), ("dim", pa.int32()), ("part", pa.int64()), ("idx", pa.int64()), ("size", pa.int32()), ("cids", pa.binary()), ("copies", pa.binary()), ("x", pa.binary()), ("p", pa.binary())] + [(f, pa.float64()) for f in floats]
    )
    assert label == "string"
    schema = "label string, dim int, part long, idx long, size int, cids binary, copies binary, x binary, p binary, " + ", ".join(f"{f} double" for f in floats)
    return cells.mapInArrow(cut, schema)


def _near_blocks(meta: DataFrame, boxes: int, eps2: float, scratch: Scratch) -> DataFrame:
    """(a, b), a <= b: pairs of block numbers whose boxes are near, by descending the intervals."""
    edge = meta.agg(F.max("seq")).first()[0]
    levels = 0
    while edge is not None and edge >> (FAN_BITS * levels):
        levels += 1
    ends = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(boxes)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(boxes)]

    def nodes(level: int) -> DataFrame:
        return meta.groupBy("label", "dim", F.shiftright("seq", FAN_BITS * level).alias("node")).agg(*ends)

    pairs = nodes(levels).select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in range(levels - 1, -1, -1):
        now = nodes(level).withColumn("up", F.shiftright("node", FAN_BITS))
        left = now.select(*[F.col(c).alias(f"a_{c}") for c in now.columns])
        right = now.select(*[F.col(c).alias(f"b_{c}") for c in now.columns])
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")) for i in range(boxes)]
        far2 = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
        half = pairs.join(left, (F.col("label") == F.col("a_label")) & (F.col("dim") == F.col("a_dim")) & (F.col("a") == F.col("a_up")))
        both = half.join(right, (F.col("label") == F.col("b_label")) & (F.col("dim") == F.col("b_dim")) & (F.col("b") == F.col("b_up")) & (F.col("a_node") <= F.col("b_node")) & (far2 <= eps2))
        pairs = scratch.save(both.select("label", "dim", F.col("a_node").alias("a"), F.col("b_node").alias("b")), f"pairs{level}")
    return pairs.select("a", "b")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; links join rows whose cosine is at least cosine.

    n_links counts other rows linked directly, component_id is the smallest id that links reach, and
    kept says whether it is the row's own.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = strip_to(vectors, id=id_col, vec=vec_col, label=label_col)
    element = rows.schema["vec"].dataType.elementType.simpleString()
    kind = "float" if element == "float" else "double"
    dtype = "<f4" if kind == "float" else "<f8"
    top = F.array_max(F.transform("vec", F.abs))
    sound = F.col("label").isNotNull() & F.coalesce(F.size("vec") > 0, F.lit(False)) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (top > 0)
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", F.col("label").cast("string").alias("label"), F.col("vec").cast(f"array<{kind}>").alias("vec"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # Adding zero makes a negative zero a positive one, so that equal vectors are equal bytes.
    rows = scratch.save(rows.withColumn("vec", F.when(F.col("sound"), F.transform("vec", lambda v: v + F.lit(0).cast(kind)))), "rows")
    classes = rows.where("sound").groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("cid"), "label", F.size("vec").alias("dim"), "vec", "copies", "least"), "classes")

    axes = principal(classes, BOX)
    eps2 = 2 - 2 * cosine + SLACK
    eps = eps2**0.5

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.zeros((b.num_rows, BOX))
            for d, at, x in _matrices(b, 4, 3):
                p[at, : axes[d].shape[1]] = x @ axes[d]
            cells = np.floor(p[:, :GRID] / eps).astype(np.int32)
            flat = b.column(4)
            raw = [np.asarray(v.values, dtype=dtype).tobytes() for v in flat]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), *[pa.array(cells[:, i]) for i in range(GRID)], pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in p], pa.binary())],
                names=["cid", "copies", "label", "dim", *[f"c{i}" for i in range(GRID)], "x", "p"],
            )

    order = ["label", "dim", *[f"c{i}" for i in range(GRID)], "cid"]
    placed = classes.select("cid", "copies", "label", "dim", "vec").mapInArrow(place, "cid long, copies long, label string, dim int, " + ", ".join(f"c{i} int" for i in range(GRID)) + ", x binary, p binary")
    placed = scratch.save(placed, "cells")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = scratch.save(_blocks(ordered, BOX), "blocks")
    most = blocks.agg(F.max("idx")).first()[0] or 0
    blocks = blocks.withColumn("seq", F.shiftleft("part", int(most).bit_length()) + F.col("idx"))
    near = _near_blocks(blocks.select("label", "dim", "seq", *[f"{s}{i}" for s in ("lo", "hi") for i in range(BOX)]), BOX, eps2, scratch)

    load = ["cids", "copies", "x", "p", "dim"]
    a = blocks.select(F.col("seq").alias("a"), *[F.col(c).alias(f"a_{c}") for c in load])
    b = blocks.select(F.col("seq").alias("b"), *[F.col(c).alias(f"b_{c}") for c in load])
    work = near.join(a, "a").join(b, "b").select("a", "b", *[f"a_{c}" for c in load], *[f"b_{c}" for c in load])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                d, same = v["a_dim"], v["a"] == v["b"]
                ids, copies, x, p = ([np.frombuffer(v[f"{s}_{c}"], dtype=t) for s in "ab"] for c, t in (("cids", "<i8"), ("copies", "<i8"), ("x", dtype), ("p", "<f8")))
                x = [_unit(m.reshape(-1, d)) for m in x]
                p = [m.reshape(-1, BOX) for m in p]
                n = [len(ids[0]), len(ids[1])]
                count = [np.zeros(n[0], dtype=np.int64), np.zeros(n[1], dtype=np.int64)]
                forest = _Forest(n[0] if same else n[0] + n[1])

                def emit(i, j, count=count, copies=copies, forest=forest, shift=0 if same else n[0]):
                    np.add.at(count[0], i, copies[1][j])
                    np.add.at(count[1], j, copies[0][i])
                    for s, t in zip(i.tolist(), j.tolist()):
                        forest.join(s, t + shift)

                join_sequences(x[0], x[1], p[0], p[1], cosine, same, emit)
                if same:
                    total, nodes = count[0] + count[1], ids[0]
                else:
                    total, nodes = np.concatenate(count), np.concatenate(ids)
                hit = np.flatnonzero(total)
                if len(hit):
                    roots = nodes[[forest.find(int(k)) for k in hit]]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(roots), pa.array(total[hit])], names=["cid", "root", "links"])

    found = scratch.save(work.mapInArrow(match, "cid long, root long, links long"), "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    known = classes.select("cid", "label", "vec", "copies", "least").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.withColumn("root", F.coalesce("root", "cid")).withColumn("n", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    known = scratch.save(known, "known")
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    of_class = split_join(known.select("label", "vec", "n", "root"), least, ["root"]).select("label", "vec", "n", "component")
    linked = split_join(rows.where("sound").select("id", "label", "vec"), of_class, ["label", "vec"]).select("id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    out = linked.unionByName(rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
