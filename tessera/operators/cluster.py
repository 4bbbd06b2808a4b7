"""Communities by the Leiden method: in one task where the arcs fit in a worker's files, before that in rounds of joins.

In a round of joins, all nodes weigh the communities around them at once.  Two nodes that move at once could
swap places or crowd into one community; so a round lets nodes move only towards smaller hashes of
community names, with a salt of its own; a round that lowers the modularity is undone, and later ones
leave fewer nodes free to move, chosen by hash.  Ties go to the smaller name, so that results
don't depend on partitions.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import PropertyGraph, shared_folder
from tessera.operators import leiden as plain
from tessera.operators.measures import community_sizes, known_edges
from tessera.operators.onetask import Arcs, numbered, rows
from tessera.operators.sketch import split_marks

#: Rounds of moves of a level, levels, and rounds without a gain after which a level ends.
ROUNDS, LEVELS, PATIENCE = 32, 12, 5
#: A round without a gain leaves so many times fewer nodes free to move.
THINNING = 3
#: Differences of gains below it count as none.
EPSILON = 1e-9
#: Arcs, both ways round, up to which one task clusters a level and those above it.  They lie in files
#: mapped into memory, 16 bytes each; a worker's memory holds arrays of nodes only.
ARCS = 64_000_000


class _Tables:
    """Written tables of one run, in the shared folder.

    A checkpoint would carry the constraints of its plan along, which double with each round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/cluster-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """The rows as a table that stays; those before it go."""
        path = f"{self.root}-result"
        df.write.parquet(path)
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return self.spark.read.schema(df.schema).parquet(path)


def _salted(name: str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col(name))


def _votes(adjacent: DataFrame, now: DataFrame, resolution: float) -> DataFrame:
    """(node, own, comm, w, gain): the communities around each node and its own, with the gain of being there.

    now: node, k (its weight), m2 (the weights of its graph), comm.
    """
    near = adjacent.join(now.select(F.col("node").alias("other"), "comm"), "other").select("node", "comm", "w")
    near = near.unionByName(now.select("node", "comm", F.lit(0.0).alias("w"))).groupBy("node", "comm").agg(F.sum("w").alias("w"))
    total = now.groupBy("comm").agg(F.sum("k").alias("tot"))
    v = near.join(now.select("node", "k", "m2", F.col("comm").alias("own")), "node").join(total, "comm")
    others = F.col("tot") - F.when(F.col("comm") == F.col("own"), F.col("k")).otherwise(0.0)
    return v.withColumn("gain", F.col("w") - resolution * F.col("k") * others / F.col("m2"))


def _quality(votes: DataFrame, resolution: float) -> float:
    """The modularity, but for constants of the level."""
    own = votes.where("comm = own")
    return own.agg(F.coalesce(F.sum(F.col("w") - resolution * F.col("k") * F.col("tot") / F.col("m2")), F.lit(0.0))).first()[0]


def _moves(tables: _Tables, adjacent: DataFrame, now: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """Moves nodes between communities while that raises the modularity."""
    best, best_quality, idle = now, None, 0  # idle: rounds of this level that gained nothing
    for salt in range(rounds):
        votes = tables.cut(_votes(adjacent, now, resolution))
        quality = _quality(votes, resolution)
        if best_quality is not None and quality <= best_quality + EPSILON:
            # The round before gained nothing: go on from the best assignment with another salt.
            idle += 1
            if idle >= PATIENCE:
                return best
            if now is not best:
                now = best
                votes = tables.cut(_votes(adjacent, now, resolution))
        else:
            best, best_quality = now, quality
        open_ = (F.col("comm") != F.col("own")) & (_salted("comm", salt) < _salted("own", salt))
        free = F.pmod(_salted("node", ~salt), F.lit(THINNING**idle)) == 0
        found = votes.where(free).groupBy("node").agg(F.max(F.when(F.col("comm") == F.col("own"), F.col("gain"))).alias("stay"), F.min(F.when(open_, F.struct((-F.col("gain")).alias("loss"), "comm"))).alias("go"))
        moved = found.where(-F.col("go.loss") > F.col("stay") + EPSILON).select("node", F.col("go.comm").alias("to"))
        now = tables.cut(now.join(moved, "node", "left").select("node", "k", "m2", F.coalesce("to", "comm").alias("comm")))
    return best


def _refined(tables: _Tables, adjacent: DataFrame, now: DataFrame, resolution: float) -> DataFrame:
    """(node, sub): parts of communities, each connected: lone nodes join parts that they have edges to.

    Nodes and parts take part if they are well linked to the rest of their community.
    """
    inside = adjacent.join(now.select("node", "comm"), "node").join(now.select(F.col("node").alias("other"), F.col("comm").alias("c")), "other").where("comm = c").select("node", "other", "w")
    inside = tables.cut(inside)
    of = now.groupBy("comm").agg(F.sum("k").alias("all"))
    base = now.join(of, "comm").select("node", "k", "m2", "all")
    state = tables.cut(base.withColumn("sub", F.col("node")))
    # At least one node joins a part in each round that has candidates, so that rounds end.
    for salt in itertools.count():
        near = inside.join(state.select(F.col("node").alias("other"), "sub"), "other").groupBy("node", F.col("sub").alias("to")).agg(F.sum("w").alias("w"))
        near = tables.cut(near.join(state.select("node", "k", "m2", "all", "sub"), "node"))
        parts = state.groupBy("sub").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
        out = near.where("to <> sub").groupBy("sub").agg(F.sum("w").alias("out"))
        parts = parts.join(out, "sub").select(F.col("sub").alias("part"), "tot", "size", "out")
        well = F.col("out") >= resolution * F.col("tot") * (F.col("all") - F.col("tot")) / F.col("m2") - EPSILON
        v = near.where("to <> sub").join(parts, F.col("to") == F.col("part")).where(well).drop("part", "size", "out").withColumnRenamed("tot", "there")
        v = v.join(parts, F.col("sub") == F.col("part")).where((F.col("size") == 1) & well)
        v = v.withColumn("gain", F.col("w") - resolution * F.col("k") * F.col("there") / F.col("m2")).where(F.col("gain") > EPSILON)
        wish = tables.cut(v.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "to")).alias("b")).select("node", F.col("b.to").alias("to")))
        if wish.isEmpty():
            return state.select("node", "sub")
        # A candidate moves to a part that stands, or to a candidate of smaller hash that doesn't move.
        also = wish.select(F.col("node").alias("to"), F.lit(True).alias("also"))
        down = F.struct(_salted("node", salt), F.col("node")) > F.struct(_salted("to", salt), F.col("to"))
        free = wish.join(also, "to", "left").where(F.col("also").isNull() | down).select("node", "to")
        joined = free.join(free.select(F.col("node").alias("to")), "to", "left_anti")
        state = tables.cut(state.join(joined, "node", "left").withColumn("sub", F.coalesce("to", "sub")).drop("to"))


def _in_one_task(tables: _Tables, adjacent: DataFrame, now: DataFrame, resolution: float, levels: int) -> DataFrame:
    """(node, sub): communities by the Leiden method from those of now on, each connected; nodes of a community have the same sub."""
    names, size = numbered(now.select("node", "k", "m2", "comm"), "node", tables.cut)
    if not size:
        return now.select("node", F.col("node").alias("sub"))
    least = names.groupBy("comm").agg(F.min("num").alias("start"))
    none = F.lit(None).cast("double")
    # Each node's own row comes before its arcs.
    own = names.join(least, "comm").select(F.col("num").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("k").alias("w"), "m2", "start")
    num = names.select("node", "num")
    arcs = adjacent.join(num.withColumnRenamed("num", "a"), "node").join(num.toDF("other", "b"), "other")
    arcs = arcs.select("a", "b", "w", none, F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            kept = Arcs(folder, {"other": "<i8", "weight": "<f8", "begin": "<i8", "k": "<f8", "m2": "<f8", "comm": "<i8"})
            n = 0
            for b in batches:
                other, weight = b.column(1).to_numpy(), b.column(2).to_numpy()
                arc = other >= 0
                heads = pa.array(~arc)
                kept.add(other=other[arc], weight=weight[arc], begin=n + (np.cumsum(arc) - arc)[~arc], k=weight[~arc])
                kept.add(m2=b.column(3).filter(heads).to_numpy(), comm=b.column(4).filter(heads).to_numpy())
                n += int(arc.sum())
            kept.add(begin=np.array([n]))
            x = kept.arrays()
            if len(x["k"]):
                found = plain.communities(np.array(x["begin"]), x["other"], x["weight"], np.array(x["k"]), np.array(x["m2"]), np.array(x["comm"]), resolution, levels)
                yield from rows(["num", "sub"], [np.arange(len(found)), found])

    made = own.union(arcs).repartition(1).sortWithinPartitions("a", "b").mapInArrow(run, "num long, sub long")
    found = tables.cut(made).join(num, "num")
    named = found.groupBy("sub").agg(F.min("node").alias("least"))
    return found.join(named, "sub").select("node", F.col("least").alias("sub"))


def leiden(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, levels: int = LEVELS, rounds: int = ROUNDS) -> DataFrame:
    """CL1: (id, community): each community connected and named by its smallest member.

    nodes: id, part; edges: src, tgt.  Graphs of different parts are clustered side by side, edges
    between them don't count.  Edges have weight 1 each and no direction, loops don't count, nulls and unknown
    ends are left out; a node without edges is a community of its own.
    """
    tables = _Tables(nodes.sparkSession)
    ids = tables.cut(nodes.where("id is not null").groupBy("id").agg(F.min("part").alias("part")))
    known = edges.where("src <> tgt").join(ids.select(F.col("id").alias("src"), F.col("part").alias("p")), "src").join(ids.select(F.col("id").alias("tgt"), F.col("part").alias("q")), "tgt").where("p = q")
    both = known.select("src", "tgt").union(known.select("tgt", "src")).toDF("node", "other")
    adjacent = tables.cut(both.groupBy("node", "other").agg(F.count("*").cast("double").alias("w")))
    weights = adjacent.groupBy("node").agg(F.sum("w").alias("k")).join(ids.select(F.col("id").alias("node"), "part"), "node")
    whole = weights.groupBy("part").agg(F.sum("k").alias("m2"))
    now = tables.cut(weights.join(whole, "part").select("node", "k", "m2", F.col("node").alias("comm")))
    at = now.select(F.col("node").alias("id"), "node")
    for level in range(levels):
        if adjacent.count() <= ARCS:
            sub = tables.cut(_in_one_task(tables, adjacent, now, resolution, levels - level))
            at = at.join(sub, "node").select("id", F.col("sub").alias("node"))
            break
        now = _moves(tables, adjacent, now, resolution, rounds)
        sub = tables.cut(_refined(tables, adjacent, now, resolution))
        before = now.count()
        at = tables.cut(at.join(sub, "node").select("id", F.col("sub").alias("node")))
        named = now.join(sub, "node")
        ends = adjacent.join(sub.withColumnRenamed("sub", "a"), "node").join(sub.select(F.col("node").alias("other"), F.col("sub").alias("b")), "other")
        adjacent = tables.cut(ends.where("a <> b").groupBy(F.col("a").alias("node"), F.col("b").alias("other")).agg(F.sum("w").alias("w")))
        now = tables.cut(named.groupBy("sub").agg(F.sum("k").alias("k"), F.first("m2").alias("m2"), F.first("comm").alias("comm")).withColumnRenamed("sub", "node"))
        if now.count() == before:
            break
    # Parts, unlike communities that a later move may have cut in two, are connected.
    found = ids.select("id").join(at, "id", "left").select("id", F.coalesce("node", "id").alias("node"))
    names = found.groupBy("node").agg(F.min("id").alias("community"))
    return tables.result(found.join(names, "node").select("id", "community"))


def cluster(g: PropertyGraph, resolution: float = 1.0) -> DataFrame:
    """CL1 to CL4: (id, community): Leiden, then once more inside communities that are too large or sparse, numbered by size."""
    first = leiden(g.nodes.select("id", F.lit("").alias("part")), known_edges(g), resolution)
    numbered = PropertyGraph(g.nodes.drop("community").join(first, "id"), g.edges)
    marked = split_marks(numbered).select(F.col("community").alias("part"))
    inner = first.join(marked, F.col("community") == F.col("part")).select("id", "part")
    if not inner.isEmpty():
        again = leiden(inner, g.edges, resolution).withColumnRenamed("community", "new")
        first = first.join(again, "id", "left").select("id", F.coalesce("new", "community").alias("community"))
    return community_sizes(first)


def modularity(assigned: DataFrame, edges: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of (id, community); loops and unknown ends don't count."""
    e = edges.where("src <> tgt").join(assigned.toDF("src", "a"), "src").join(assigned.toDF("tgt", "b"), "tgt")
    ends = e.select(F.explode(F.array("a", "b")).alias("c"), (F.col("a") == F.col("b")).alias("same"))
    per = ends.groupBy("c").agg(F.count("*").alias("k"), F.count_if("same").alias("inside"))
    k, inside, squares = per.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k").cast("double") * F.col("k"))).first()
    return inside / k - resolution * squares / k / k if k else 0.0
