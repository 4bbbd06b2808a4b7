"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint becomes 32 counts, the bits set in each 2-bit segment.  The Manhattan distance
of two such vectors is never above the fingerprints' Hamming distance.  The segments are dealt to
groups; for fingerprints within a distance d at least one group is within d // groups.  So each
group is a grid that is range-joined with that radius: one side gives its cell, the other its own
and the neighbouring cells upwards, and the exact Hamming distance decides inside the join.

Only distinct fingerprints are joined, so that copies never form pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import exact_dedup
from tessera.llm.components import components
from tessera.llm.shared import BROADCAST_BYTES, Scratch, small, split_join, strip_to, workers

BITS, SEED = 64, 42
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 16
#: Distinct fingerprints with a link go on as 64-bit nodes.
SEGMENTS = 32
_LOW = 0x5555555555555555


def fingerprint(text: str | None, words: int = 3, distinct: bool = False) -> int:
    """The fingerprint of a text as a signed 64-bit integer; null and blank texts have 0.

    A-Z is lower-cased.  Words are runs of anything but ASCII white space, and shingles all runs of
    so many words, repeats included unless distinct is set; a shorter text is one shingle.  A bit is
    set if over half of the shingles' XXH64 have it.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    values = shingle_hashes(parts, words)
    if distinct:
        values = np.unique(values)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(values), CHUNK):
        part = values[i : i + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """XXH64 of every run of so many words, or of all words if there are fewer."""
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(b" ".join(parts), SEED)]
    else:
        line, at, starts = b" ".join(parts), 0, []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        starts.append(at)
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[words:])]
    return np.array(hashes, dtype="<u8")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes in order; a blank text has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(shingle_hashes(parts, words)) if parts else np.empty(0, dtype="<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distinct: bool = False) -> DataFrame:
    """(id, fp) of every row, fp as a signed long."""
    workers(docs.sparkSession)
    rows = strip_to(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), words, distinct) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, fp long")


def packed_popcounts(bits: Column) -> Column:
    """The counts (0, 1 or 2) of the 2-bit segments of up to 62 bits, in two bits each."""
    return bits.bitwiseAND(F.lit(_LOW)) + F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_LOW))


def links(fps: DataFrame, distance: int = 2, groups: int = 2) -> DataFrame:
    """Pairs (a, b), a < b or either way round, of distinct fingerprints within the distance.

    fps: distinct fp.  A pair can come once from each group.  More groups give fewer neighbouring
    cells, but larger ones.  The radius distance // groups may be 0 or 1.
    """
    radius = distance // groups
    if radius > 1 or groups < 2:
        raise ValueError("choose two groups or more, so that distance // groups is 0 or 1")
    per = -(-SEGMENTS // groups)
    shifts = [2 * per * g for g in range(groups)]
    masks = [(1 << 2 * min(per, SEGMENTS - per * g)) - 1 for g in range(groups)]

    def part(g: int) -> Column:
        return packed_popcounts(F.shiftrightunsigned("fp", shifts[g]).bitwiseAND(F.lit(masks[g])))

    cells = fps.select("fp", F.posexplode(F.array(*[part(g) for g in range(groups)])).alias("grp", "cell"))
    a = cells.select(F.col("fp").alias("a"), F.col("grp").alias("ga"), F.col("cell").alias("ca"))
    own = cells.select(F.col("fp").alias("b"), "grp", "cell", F.lit(False).alias("up"))
    probes = own
    if radius:
        steps = F.array(*[F.lit(1 << 2 * i).cast("long") for i in range(per)])
        field = lambda s: F.col("cell").bitwiseAND(s * 3)
        # A count below 2 can grow by one without a carry.
        ups = F.transform(F.filter(steps, lambda s: field(s) < s * 2), lambda s: F.col("cell") + s)
        probes = own.union(cells.select(F.col("fp").alias("b"), "grp", F.explode(ups).alias("cell"), F.lit(True).alias("up")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    meets = (F.col("ca") == F.col("cell")) & (F.col("ga") == F.col("grp")) & near & (F.col("up") | (F.col("a") < F.col("b")))
    return a.join(probes, meets).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, groups: int = 2, distinct: bool = False) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the smallest id that links reach.

    Documents of equal fingerprint are linked, blank ones among them.  A null id is in a component
    like any other, but never its smallest id, unless all are null.  Repeated rows keep each their
    row.  An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.save(fingerprints(docs, id_col, text_col, words, distinct), "fps")
    own = scratch.save(narrow.groupBy("fp").agg(F.min("id").alias("least")), "own")
    rooted = scratch.save(own.join(_classes(own, scratch, distance, groups), "fp"), "rooted")
    scratch.drop_all(but=("fps", "rooted"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = split_join(rooted.select("fp", "root"), least, ["root"]).select("fp", "component_id")
    out = split_join(narrow, of_fp, ["fp"], "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classes(own: DataFrame, scratch: Scratch, distance: int, groups: int) -> DataFrame:
    """(fp, root): components of distinct fingerprints, all of them joined at the distance."""
    found = scratch.save(links(own.select("fp"), distance, groups), "links")
    step = components(found, scratch).withColumnRenamed("node", "fp")
    roots = scratch.save(own.select("fp").join(step, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    scratch.drop("links")
    return roots


#: Words of a shingle, and the part of shingles that near duplicates share at least.
SHINGLE, SIMILARITY = 5, 0.8
#: Documents whose shingles are counted, the count from which a shingle is frequent, and the most
#: that are remembered.  They decide on the order of shingles only, so on cost, never on results.
SAMPLE, FREQUENT, REMEMBERED = 10_000, 3, 50_000
#: All pairs are taken once they are so many for each row of the index; before, leaders thin it out.
PAIRS = 4
#: Allowance for rounding, so that bounds admit what the exact comparison admits.
EPSILON = 1e-9
#: Words of a shingle, distance and groups of the fingerprints by which near duplicates are looked for first.
MARK_WORDS, MARK_DISTANCE, MARK_GROUPS = 1, 2, 2
#: Values of prefixes that are searched at once for those of more than one row.
BUCKET = 1 << 19
#: Pairs of sets in an Arrow batch, as both may be of long texts.
WIDE, ARROW_ROWS = 100, "spark.sql.execution.arrow.maxRecordsPerBatch"


def frequency(values: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rank of each value, 0 of those that are not in common."""
    if not len(common):
        return np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
    return np.where(common[at] == values, ranks[at], 0)


def prefix(values: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n distinct shingles, those in common last, by rank.

    Two sets whose Jaccard similarity is at least similarity share one of their prefixes, whatever
    the order is, if it is the same for all sets.  An empty set has the one value 0.
    """
    n = len(values)
    if not n:
        return np.zeros(1, dtype="<u8")
    order = np.lexsort((values, frequency(values, common, ranks)))
    return values[order[: n - int(np.ceil((similarity - EPSILON) * n)) + 1]]


def listed(parts: list[np.ndarray]) -> pa.ListArray:
    """A list of longs for each part."""
    ends = np.cumsum([0] + [len(p) for p in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int64()))


def meeting(lists: DataFrame, buckets: int) -> DataFrame:
    """(row, value) of each value that is in the lists of more than one row.

    lists: row, a distinct long, and distinct longs.  The values are exchanged once, dealt to buckets by
    value and packed for each batch of rows, so that one takes 8 bytes and its row 2 where rows of
    a batch are numbered closely, as those of a file are, else 8.  A bucket has to fit in a task.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(b.column(0).to_numpy(zero_copy_only=False), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            if not len(values):
                continue
            bucket = (values.view("<u8") % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((rows, bucket))
            values, rows, bucket = values[order], rows[order], bucket[order]
            # Rows of each input partition are numbered from a multiple of 2**33 on.
            starts = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(rows >> 33) != 0)])
            ends = np.append(starts, len(values))
            steps = rows - np.repeat(rows[starts], np.diff(ends))
            steps = steps.astype("<u2" if steps.max() < 1 << 16 else "<i8")
            packed = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * x.itemsize).astype("<i4")), pa.py_buffer(x)]) for x in (steps, values)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array(rows[starts], pa.int64()), *packed], names=["bucket", "base", "steps", "vals"])

    def find(group: pa.Table) -> pa.Table:
        rows, values = [], []
        for base, steps, vals in zip(group.column("base").to_pylist(), group.column("steps").to_pylist(), group.column("vals").to_pylist()):
            values.append(np.frombuffer(vals, "<i8"))
            rows.append(np.frombuffer(steps, "<i8" if len(steps) == len(vals) else "<u2").astype(np.int64) + base)
        rows, values = np.concatenate(rows), np.concatenate(values)
        order = np.argsort(values, kind="stable")
        same = np.zeros(len(order) + 1, dtype=bool)
        same[1:-1] = np.diff(values[order]) == 0
        order = order[same[1:] | same[:-1]]
        return pa.table({"row": pa.array(rows[order], pa.int64()), "value": pa.array(values[order], pa.int64())})

    return lists.mapInArrow(deal, "bucket long, base long, steps binary, vals binary").groupBy("bucket").applyInArrow(find, "row long, value long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of near duplicates.

    In the order of ids a row goes if the Jaccard similarity of its distinct shingles to those of a
    row that stays is at least similarity; else it stays.  Fingerprints are linked first, by the grid
    range-join, and each row is held against the first row near its fingerprint.  Similar rows whose
    fingerprints are farther apart share a shingle of their prefixes; all other rows that do are compared, but
    for those that have gone and those whose sizes and common shingles of prefixes rule it out.  So the search is exact.  Equal texts (null counts as
    empty) go first, but for one of the smallest id.  Blank texts are near each other only.  A null
    id is smaller than any id.
    """
    scratch = Scratch(docs.sparkSession)
    workers(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.unhex(F.md5(body))
    known = scratch.save(docs.select(digest.alias("dig")).groupBy("dig").agg(F.count("*").alias("n")).agg(F.count("*").alias("texts"), F.sum("n").alias("rows")), "known").first()
    if known["texts"] < (known["rows"] or 0):
        docs = scratch.save(exact_dedup.dedup(docs, id_col, text_col, keep="min"), "docs")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), digest.alias("dig"), body.alias("text"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle).astype("<i8"), pa.int64())], names=["h"])

    parts = max(1, known["texts"] // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("dig"), F.lit(parts)) == 0).select("text")
    counts = some.mapInArrow(sampled, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = sorted((r.h % (1 << 64), r.n) for r in counts.orderBy(F.desc("n"), "h").limit(REMEMBERED).collect())
    common, ranks = np.array([h for h, _ in top], dtype="<u8"), np.array([n for _, n in top], dtype=np.int64)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t.as_py(), shingle) for t in b.column(2)]
            firsts = [prefix(m, similarity, common, ranks).astype("<i8") for m in made]
            # Frequent ones need no search for a second row, so that no bucket has many rows of one value.
            known = [(frequency(f.view("<u8"), common, ranks) > 0) | (f == 0) for f in firsts]
            rare, often = (listed([f[k == kind] for f, k in zip(firsts, known)]) for kind in (False, True))
            fps = pa.array([fingerprint(t.as_py(), MARK_WORDS, distinct=True) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(m) for m in made], pa.int32()), rare, often, fps], names=["id", "dig", "size", "rare", "often", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.select("id", "dig", "text").mapInArrow(prefixes, f"id {kind}, dig binary, size int, rare array<long>, often array<long>, fp long")
    made = scratch.save(made.withColumn("row", F.monotonically_increasing_id()), "made")
    # Numbers in the order of ids, so that they stand for them from here on.
    ordered = made.select("row", "dig", "id").orderBy(F.col("id").isNotNull(), "id", "dig")
    names = scratch.save(ordered.select("row", "dig").withColumn("num", F.monotonically_increasing_id()), "names")
    marks = scratch.save(split_or_small(made.select("row", "size", "fp"), scratch, "names", names.select("row", "num"), ["row"]).select("row", "num", "size", "fp"), "marks")
    # A prefix of n has at most (1 - similarity) * n + 1 values.
    values = made.agg(F.sum(F.col("size") * (1 - similarity) + 1)).first()[0] or 0
    met = meeting(made.select("row", "rare"), 1 + int(values) // BUCKET).withColumnRenamed("value", "h").union(made.select("row", F.explode("often")))
    post = scratch.save(split_or_small(met, scratch, "marks", marks.select("row", "num", "size"), ["row"]).select("h", "num", "size"), "post0")
    scratch.drop("made")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["num", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    def candidates(met: DataFrame) -> DataFrame:
        """The pairs (a, b) of rows (a, size_a, num, size), one for each common shingle of prefixes, that may be near.

        What a pair has in common is in both prefixes, or behind the prefix of the one that ends first.
        """
        alike = met.where(F.least("size", "size_a") >= F.greatest("size", "size_a") * (similarity - EPSILON))
        behind = F.ceil(F.greatest("size", "size_a") * (similarity - EPSILON)) - 1
        need = (F.col("size") + F.col("size_a")) * (similarity / (1 + similarity) - EPSILON)
        return alike.groupBy("a", "size_a", "num", "size").agg(F.count("*").alias("n")).where(F.col("n") + behind >= need).select("a", F.col("num").alias("b"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are near, saved under the name."""
        pairs = scratch.save(pairs, "pairs")
        need = scratch.save(pairs.select(F.col("a").alias("num")).union(pairs.select("b")).distinct(), "need")
        need = scratch.save(split_or_small(names.select("num", "dig"), scratch, "need", need, ["num"], "left_semi"), "need")
        texts = split_or_small(rows.select("dig", "text"), scratch, "need", need, ["dig"]).select("num", "text")
        has = scratch.save(texts.mapInArrow(sets, "num long, set binary"), "sets")
        one = split_or_small(pairs, scratch, "sets", has.select(F.col("num").alias("b"), F.col("set").alias("set_b")), ["b"])
        two = split_or_small(one, scratch, "sets", has.select(F.col("num").alias("a"), F.col("set").alias("set_a")), ["a"])
        rows_a_batch = docs.sparkSession.conf.get(ARROW_ROWS)
        workers(docs.sparkSession, WIDE)
        out = scratch.save(two.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long, near boolean").where("near").select("a", "b"), name)
        docs.sparkSession.conf.set(ARROW_ROWS, rows_a_batch)
        for n in ("pairs", "need", "sets"):
            scratch.drop(n)
        return out

    alike = verified(_first_alike(marks.drop("row"), scratch, similarity), "alike")
    scratch.drop("marks")
    gone, i, before = [], 0, None
    while True:
        heads = scratch.save(post.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("num", "size")).alias("lead")).where("n > 1"), "heads")
        load = heads.agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).first()
        # Few pairs are left, or leaders have stopped to thin them out.
        if not load["rows"] or load["pairs"] <= PAIRS * load["rows"] or (before and load["pairs"] > 0.9 * before):
            break
        before = load["pairs"]
        led = scratch.save(split_or_small(post, scratch, "heads", heads.select("h", "lead"), ["h"]).select("num", "size", F.col("lead.num").alias("a"), F.col("lead.size").alias("size_a")), "led")
        # The first row of all its shingles has no smaller row left that may be near: it stays.
        stay = scratch.save(led.groupBy("num").agg(F.min("a").alias("a")).where("num = a").select("a"), "stay")
        marked = scratch.save(split_or_small(alike, scratch, "stay", stay, ["a"], "left_semi").select(F.col("b").alias("num")), f"marked{i}")
        # It leads all of its shingles, so that all that it has in common with a row is here.
        left = split_or_small(led.where("num <> a"), scratch, f"marked{i}", marked, ["num"], "left_anti")
        hits = verified(candidates(split_or_small(left, scratch, "stay", stay, ["a"], "left_semi")), f"hits{i}").select(F.col("b").alias("num")).distinct()
        gone += [marked, hits]
        done = scratch.save(marked.union(hits).union(stay), "done")
        post = scratch.save(split_or_small(post, scratch, "done", done, ["num"], "left_anti"), f"post{i + 1}")
        rest = split_or_small(alike, scratch, "done", done.select(F.col("num").alias("a")), ["a"], "left_anti")
        alike = scratch.save(split_or_small(rest, scratch, "done", done.select(F.col("num").alias("b")), ["b"], "left_anti"), "alike")
        for name in (f"post{i}", "led", "stay", "done"):
            scratch.drop(name)
        i += 1

    own = split_or_small(post, scratch, "heads", heads.select("h"), ["h"], "left_semi")
    other = own.select("h", F.col("num").alias("a"), F.col("size").alias("size_a"))
    pairs = candidates(split_join(own, other, ["h"]).where("a < num"))
    near = verified(split_or_small(pairs, scratch, "alike", alike, ["a", "b"], "left_anti"), "near")
    near = scratch.save(near.unionByName(alike), "near")
    # A row that no open row before it is near stays, and what is near it goes, until none is left.
    k = 0
    while near.limit(1).count():
        first = near.select("a").distinct().join(near.select(F.col("b").alias("a")), "a", "left_anti")
        first = scratch.save(first, "first")
        out = scratch.save(split_or_small(near, scratch, "first", first, ["a"], "left_semi").select(F.col("b").alias("num")).distinct(), f"out{k}")
        gone.append(out)
        rest = split_or_small(near, scratch, f"out{k}", out.withColumnRenamed("num", "a"), ["a"], "left_anti")
        near = scratch.save(split_or_small(rest, scratch, f"out{k}", out.withColumnRenamed("num", "b"), ["b"], "left_anti"), "near")
        k += 1
    drop = names.select("num").limit(0)
    for g in gone:
        drop = drop.union(g)
    drop = scratch.save(drop.distinct(), "nums")
    drop = scratch.save(split_or_small(names, scratch, "nums", drop, ["num"], "left_semi").select(F.col("dig").alias("_gone")), "drop")
    scratch.drop_all(but=("drop", "docs"))
    out = docs.withColumn("_dig", digest).join(small(scratch, "drop", drop), F.col("_dig") == F.col("_gone"), "left_anti")
    return out.drop("_dig")


def _first_alike(marks: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """(a, b): for each row b the first row a before it whose fingerprint is near, if their sizes allow the similarity.

    marks: num, size, fp.  There is one pair a row at most, however large a group is.
    """
    own = scratch.save(marks.groupBy("fp").agg(F.min(F.struct("num", "size")).alias("lead")), "own")
    found = scratch.save(links(own.select("fp"), MARK_DISTANCE, MARK_GROUPS), "links")
    both = found.select(F.col("a").alias("near"), F.col("b").alias("fp")).union(found.select("b", "a"))
    leads = split_or_small(both, scratch, "own", own.withColumnRenamed("fp", "near"), ["near"]).select("fp", "lead")
    first = scratch.save(leads.union(own.select("fp", "lead")).groupBy("fp").agg(F.min("lead").alias("lead")), "first")
    pairs = split_or_small(marks, scratch, "first", first, ["fp"]).where("lead.num < num")
    alike = F.least("size", "lead.size") >= F.greatest("size", "lead.size") * (similarity - EPSILON)
    out = scratch.save(pairs.where(alike).select(F.col("lead.num").alias("a"), F.col("num").alias("b")), "tried")
    for name in ("own", "links", "first"):
        scratch.drop(name)
    return out


def split_or_small(left: DataFrame, scratch: Scratch, name: str, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a saved table: broadcast if it is small, else with exchanges that can be split."""
    if scratch.bytes_of(name) * 4 <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return split_join(left, right, on, how)
