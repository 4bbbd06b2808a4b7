"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size gives how often each of its documents is taken: a whole number of
times, and once more with the remaining probability.  The flight phase moves these probabilities
through the null-space of the balancing equations (numbers of documents and words) until nearly all
are 0 or 1.  It runs in chunks of bounded size; what a chunk leaves open, two documents at most,
flies again with a small reserve and with what other chunks of the source left, until one chunk is
left.  Its last documents land on the nearest total, and a few trades take off what rounding left.

Defined results: a null text has size 0.  A null source is a source of its own, the last in order.
Sources without a word have target 0.  Rows that repeat source, id and text are counted first and
numbered, so that any number of copies is dealt evenly to the chunks.  Chunks and draws follow from
the seed, the source, the id, the text and that number, so reruns agree.  An empty table gives an
empty table.
"""

from __future__ import annotations

import bisect
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, small, strip_to, workers

#: Documents that fly together.
CHUNK = 1024
#: Chunks whose open documents fly together at the next level.
FAN_IN = 16
#: Documents of a chunk that don't fly before the last level, so that it has enough to land well.
RESERVE = 62
#: A target is at most so many times its source's size.
MOST = 3
EPS = 1e-9
#: Copies of a row that one task numbers at a time.
BLOCK = 1 << 16


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs), one row a source.

    Sources by code point, null last, have the weights in turn and share the sum of all sizes.
    Where a share is above most times the source's size, it stops there and the rest is shared
    anew.  In order of cap / weight that is one level for all sources below their cap.
    The windows have one partition of as many rows as there are sources.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("level", (F.col("total") - before) / after)
    fits = F.col("level") * F.col("w") <= F.col("cap")
    level = F.min(F.when(fits, F.struct("place", "level"))).over(everything).getField("level")
    return rows.withColumn("level", level).select("source", "source_size", "docs", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def fly(x: list[float], p: list[float], rng: random.Random) -> None:
    """The flight phase: moves p in place along constant sum(p) and sum(p * x) until two at most are open."""
    open_: list[int] = []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = float(round(p[k]))
            continue
        open_.append(k)
        while True:
            step = _direction([x[i] for i in open_])
            if step is None:
                break
            _move(open_, p, step, rng)
            open_ = [i for i in open_ if 0 < p[i] < 1]


def _direction(x: list[float]) -> list[float] | None:
    """A vector of the null-space of (1, ..., 1) and x, for up to three documents."""
    if len(x) >= 2:
        for i in range(len(x)):
            for j in range(i):
                if x[i] == x[j]:
                    return [1.0 if k == i else -1.0 if k == j else 0.0 for k in range(len(x))]
    if len(x) == 3:
        u = [x[1] - x[2], x[2] - x[0], x[0] - x[1]]
        top = max(map(abs, u))
        return [v / top for v in u]
    return None


def _move(where: list[int], p: list[float], u: list[float], rng: random.Random) -> None:
    """One step to a face of the cube, forwards or back, so that no expectation changes."""
    ahead = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(where, u) if v)
    back = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(where, u) if v)
    size = ahead if rng.random() * (ahead + back) < back else -back
    for i, v in zip(where, u):
        q = p[i] + size * v
        p[i] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q


def land(x: list[float], p: list[float], rng: random.Random) -> None:
    """Rounds what the flight left open: first along constant words, then to the nearest total."""
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    while len(open_) >= 2:
        a, b = open_[:2]
        u = [x[b], -x[a]] if x[a] and x[b] else [1.0, 0.0] if not x[a] else [0.0, 1.0]
        top = max(map(abs, u))
        _move([a, b], p, [v / top for v in u], rng)
        open_ = [i for i in open_ if 0 < p[i] < 1]
    for i in open_:
        p[i] = 1.0 if p[i] >= 0.5 else 0.0


def swap(x: list[float], p: list[float], words: float) -> None:
    """Ends the landing: trades a taken document for one that isn't while that brings the words nearer.

    A trade keeps the number of documents; where none helps, a single one may come or go.
    """
    for _ in range(len(p)):
        error = sum(a * b for a, b in zip(x, p)) - words
        inside = sorted((x[i], i) for i in range(len(p)) if p[i] == 1)
        outside = sorted((x[i], i) for i in range(len(p)) if p[i] == 0)
        lengths = [v for v, _ in outside]
        best = (abs(error), 0, ())
        for v, i in inside:
            at = bisect.bisect_left(lengths, v - error)
            for j in (at - 1, at):
                if 0 <= j < len(outside):
                    best = min(best, (abs(error - v + outside[j][0]), 1, (i, outside[j][1])))
            best = min(best, (abs(error - v), 2, (i,)))
        for v, i in outside:
            best = min(best, (abs(error + v), 2, (i,)))
        if best[0] >= abs(error) - EPS:
            break
        for i in best[2]:
            p[i] = 1 - p[i]


def refill(x: list[float], p: list[float], words: float) -> None:
    """Where trades of two leave the words far off, one document comes or goes and shorter ones make up for it."""
    error = sum(a * b for a, b in zip(x, p)) - words
    by_size = sorted(range(len(p)), key=lambda i: (-x[i], i))
    best, best_p, tried = abs(error), None, set()
    for i in by_size:
        if best < 1 or x[i] <= abs(error) or (p[i] > 0) != (error > 0) or x[i] in tried:
            continue
        tried.add(x[i])
        q, e = list(p), error + (-x[i] if p[i] else x[i])
        q[i] = 1 - q[i]
        for j in by_size:
            step = -x[j] if q[j] else x[j]
            if x[j] < x[i] and abs(e + step) < abs(e):
                q[j], e = 1 - q[j], e + step
        if abs(e) < best:
            best, best_p = abs(e), q
    if best_p is not None:
        p[:] = best_p
        swap(x, p, words)


def _flight(seed: int, level: int):
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        # In the last flight long documents go first: the short ones behind them settle them.
        last = f["chunks"].iloc[0] <= 1
        by, up = (["size", "pick", "place"], [False, True, True]) if last else (["pick", "size", "place"], True)
        f = f.sort_values(by, ascending=up, kind="stable").reset_index(drop=True)
        x, p = f["size"].astype(float).tolist(), f["p"].tolist()
        rng = random.Random(f"{seed}/{level}/{f['source'].iloc[0]!r}/{key[1]}")
        if last:
            words = sum(a * b for a, b in zip(x, p))
            fly(x, p, rng)
            land(x, p, rng)
            swap(x, p, words)
            refill(x, p, words)
        else:
            n = max(0, len(p) - RESERVE)
            head = p[:n]
            fly(x[:n], head, rng)
            p = head + p[n:]
        return f.assign(p=p)

    return run


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = MOST, seed: int = 42, pick_col: str | None = None) -> DataFrame:
    """(id, size, source_size, target, times, taken) of every row.

    times: how often the mixture has the document; taken: times * size.
    pick_col: a long that deals documents to chunks, instead of a hash of id and text.
    """
    scratch = Scratch(docs.sparkSession)
    workers(docs.sparkSession)
    rows = strip_to(docs, id=id_col, text=text_col, source=source_col, **({"pick": pick_col} if pick_col else {}))
    pick = F.col("pick") if pick_col else F.xxhash64("id", "text")
    narrow = rows.select("id", "source", word_count(F.col("text")).alias("size"), pick.alias("pick"))
    # Rows that agree in all of these stand for each other: they are counted, which combines before
    # the shuffle, and numbered in blocks, so that no task holds all copies of one.
    counted = scratch.save(narrow.groupBy("id", "source", "size", "pick").agg(F.count("*").alias("n")), "counted")
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))))
    if counted.where(F.col("n") > BLOCK).limit(1).count():
        blocks = scratch.save(blocks, "blocks").repartition("pick", "block")
    first = F.col("block") * BLOCK
    numbered = blocks.withColumn("place", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("n")) - 1)))
    units = scratch.save(numbered.select("id", "source", "size", "pick", "place"), "units")
    for name in ("counted", "blocks"):
        scratch.drop(name)
    per_source = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = scratch.save(targets(per_source, weights, most), "targets")
    largest = goal.agg(F.max("docs")).first()[0] or 0

    g = small(scratch, "targets", goal).withColumnRenamed("source", "_source")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = units.join(g, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("times", times)
    placed = placed.withColumn("base", F.floor(F.col("times") + EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("times") - F.col("base")))
    placed = placed.withColumn("chunks", F.ceil(F.col("docs") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("pick", "place"), "chunks"))
    placed = placed.drop("docs", "times")

    done, level = [], 0
    while True:
        schema = placed.schema
        # Null sources are a group like any other in groupBy.
        flown = scratch.save(placed.groupBy("source", "chunk").applyInPandas(_flight(seed, level), schema), f"flown{level}")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~is_open))
        if largest <= CHUNK:
            break
        largest = -(-largest // FAN_IN)
        placed = flown.where(is_open).withColumn("chunks", F.ceil(F.col("chunks") / FAN_IN)).withColumn("chunk", F.pmod("chunk", "chunks"))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    scratch.drop_all(but=tuple(f"flown{i}" for i in range(level + 1)))
    n = (F.col("base") + F.round("p")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", n.alias("times"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = MOST, seed: int = 42) -> DataFrame:
    """The rows of docs as the mixture has them: left out, once, or repeated; with all their columns.

    Rows are known by a hash of all their columns.  Rows that repeat them all stand for each other:
    one of them comes as often as the mixture has them together.
    """
    scratch = Scratch(docs.sparkSession)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    parts = [mark(id_.cast("string")), mark(F.sha2(text, 256)), *([F.to_json(F.struct(*rest))] if rest else [])]
    keyed = docs.withColumn("_row", F.unhex(F.md5(F.concat_ws("/", *parts))))
    of = mixture(keyed.select("_row", text.alias("text"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(id_, text).alias("_pick")), "_row", "text", "source", weights, most, seed, "_pick")
    often = of.groupBy("_row").agg(F.count("*").alias("_n"), F.sum("times").alias("_times"))
    often = scratch.save(often, "often")
    if often.where("_n > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["_row"])
    # One row a document: a sort-merge join at every size.
    out = keyed.join(often.where("_times > 0").select(F.col("_row").alias("_often"), "_times").hint("merge"), F.col("_row") == F.col("_often"))
    blocks = out.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_times - 1) div {BLOCK}"))))
    copies = blocks.withColumn("_copy", F.explode(F.sequence(F.col("_block") * BLOCK, F.least((F.col("_block") + 1) * BLOCK, F.col("_times")) - 1)))
    return copies.drop("_row", "_often", "_times", "_block", "_copy")
