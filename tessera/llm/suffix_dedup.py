"""Removal of byte strings that occur twice, by suffix arrays with two-stage sorting.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.  Where such a
string starts is a window.  Windows are first dealt to groups by the smallest hash of the short
grams inside (their minimizer): equal windows have the same, so a group that holds one run of
windows and repeats nothing is settled.  For all other groups the bytes of their runs are gathered,
and a suffix array of them is built in two stages: suffixes smaller than their successors are sorted
directly, the rest is induced from them by scans of the buckets of first bytes.  Neighbours in the
array with a common prefix of `length` bytes are equal windows.

Groups of more than GROUP_BYTES are dealt to several arrays; what each array holds is then compared
by digests of one window of each class, so that no group is too large for a task.  Equal texts are
one text throughout: all their windows are repeats.

Defined results: a null text counts as empty; texts shorter than `length` keep all bytes.  Repeated
rows are equal texts.  An empty table gives an empty table.  Extra input columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, small, split_join, strip_to, workers

LENGTH = 400
#: Bytes of a minimizer's gram; a multiple of 8.
GRAM = 32
#: Window starts that are hashed at once, and that a run has at most.
BLOCK, PIECE = 1 << 22, 8192
#: Bytes that one suffix array gathers, and of a group that go to one array.
ARRAY_BYTES, GROUP_BYTES = 256 << 10, 4 << 20
#: Bytes that one task sorts in all.
TASK_BYTES = 24 << 20
_POS = 24


def _gram_hashes(raw: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of gram bytes."""
    n = len(raw) - gram + 1
    h = np.zeros(n, dtype=np.uint64)
    for off in range(0, gram, 8):
        h += np.ndarray((n,), dtype="<u8", buffer=raw, offset=off, strides=(1,))
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, by running minima of blocks from both sides."""
    n = len(x) - w + 1
    pad = -len(x) % w
    full = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows, again) of each run of windows with one minimizer.

    again: the minimizer comes twice in the run, so that the run may repeat within itself.
    """
    out = []
    for at in range(0, len(raw) - length + 1, BLOCK):
        part = raw[at : at + BLOCK + length - 1]
        h = _gram_hashes(part, gram)
        packed = (h & np.uint64((1 << 64) - (1 << _POS))) | np.arange(len(h), dtype=np.uint64)
        pos = (_sliding_min(packed, length - gram + 1) & np.uint64((1 << _POS) - 1)).astype(np.int64)
        v = h[pos]
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1
        starts = np.concatenate(([0], cut))
        ends = np.concatenate((cut, [len(v)]))
        moved = np.concatenate(([0], np.cumsum(pos[1:] != pos[:-1])))
        again = moved[ends - 1] != moved[starts]
        pieces = -(-(ends - starts) // PIECE)
        if (pieces > 1).any():
            first = np.repeat(starts, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            last = np.minimum(first + PIECE, np.repeat(ends, pieces))
            starts, ends, again = first, last, np.repeat(again, pieces)
        out.append((v[starts].view(np.int64), starts + at, ends - starts, again))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
    return tuple(np.concatenate(c) for c in zip(*out))


def suffix_order(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, symbols, begins): the suffixes of all texts in order of their first length bytes.

    symbols are the texts' bytes plus one, with a zero before, between and after them; begins are
    the texts' first places in it.  Suffixes with equal first bytes come in any order.
    """
    blob = b"\0" + b"\0".join(texts) + b"\0"
    begins = np.cumsum([1, *[len(t) + 1 for t in texts[:-1]]])
    ends = begins + np.array([len(t) for t in texts])
    s = np.frombuffer(blob, dtype=np.uint8).astype(np.int16) + 1
    s[0] = 0
    s[ends] = 0
    n = len(s)
    # A suffix is smaller than its successor if the first byte that differs from it is larger.
    step = np.sign(np.diff(s))
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1), n - 2)[::-1])[::-1]
    rising = np.zeros(n, dtype=bool)
    rising[:-1] = step[nearest] > 0
    rising[s == 0] = False

    # By the first two bytes, so that the keys of one bucket only are held at a time.
    direct = np.flatnonzero(rising)
    pair = s[direct].astype(np.int32) * 257 + s[direct + 1]
    by = np.argsort(pair, kind="stable")
    direct, pair = direct[by], pair[by]
    stop = np.minimum(direct + length, ends[np.searchsorted(ends, direct)])
    edges = np.concatenate(([0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(direct)])).tolist() if len(direct) else [0]
    for x, y in zip(edges, edges[1:]):
        if y - x > 1:
            keys = [blob[i:j] for i, j in zip((direct[x:y] + 2).tolist(), stop[x:y].tolist())]
            direct[x:y] = direct[x:y][sorted(range(y - x), key=keys.__getitem__)]
    direct_at = np.searchsorted(s[direct], np.arange(258))

    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]

    def deal(source: np.ndarray, c: int) -> None:
        """Predecessors that begin with a larger byte go to the heads of its bucket."""
        before = source - 1
        first = s[before]
        larger = first > c
        before, first = before[larger], first[larger]
        if len(before):
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for k, group in zip(first[np.concatenate(([0], cuts))].tolist(), np.split(before, cuts)):
                waiting[k].append(group)

    out = []
    deal(ends, 0)
    for c in np.unique(s[s > 0]).tolist():
        falling = list(waiting[c])
        now = np.concatenate(falling) if falling else np.empty(0, dtype=np.int64)
        while len(now):  # a byte that repeats: the bucket goes on with its own predecessors
            now = now[s[now - 1] == c] - 1
            if len(now):
                falling.append(now)
        whole = np.concatenate([*falling, direct[direct_at[c] : direct_at[c + 1]]])
        waiting[c] = []
        deal(whole, c)
        out.append(whole)
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64), s, begins


def window_classes(texts: list[bytes], windows: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, same, repeated) of all windows in suffix order.

    windows: how many of each text's first offsets are windows.  same: the window equals the one
    before; repeated: it equals a neighbour on either side.
    """
    order, s, begins = suffix_order(texts, length)
    is_window = np.zeros(len(s) + 1, dtype=np.int64)
    is_window[begins] += 1
    np.subtract.at(is_window, begins + np.array(windows), 1)
    order = order[np.cumsum(is_window)[order] > 0]
    # A rolling hash tells most neighbours apart; where it agrees, the bytes are compared.
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(len(s), base, dtype=np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(len(s), np.uint64(pow(int(base), -1, 1 << 64)), dtype=np.uint64), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(s.astype(np.uint64) * power, dtype=np.uint64)))
    h = (sums[order + length] - sums[order]) * back[order]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    blob = s.astype("<u2").tobytes()
    for k in np.flatnonzero(same).tolist():
        i, j = 2 * int(order[k - 1]), 2 * int(order[k])
        if blob[i : i + 2 * length] != blob[j : j + 2 * length]:
            same[k] = False
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    text = np.searchsorted(begins, order, side="right") - 1
    return text, order - begins[text], same, repeated


def _spans(text: np.ndarray, offset: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(text, from, to) of the bytes that windows cover, neighbouring windows in one."""
    by = np.lexsort((offset, text))
    text, offset = text[by], offset[by]
    cuts = np.flatnonzero((text[1:] != text[:-1]) | (offset[1:] - offset[:-1] > length)) + 1
    first = np.concatenate(([0], cuts))
    last = np.concatenate((cuts, [len(text)])) - 1
    return zip(text[first].tolist(), offset[first].tolist(), (offset[last] + length).tolist())


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    out, _ = _removed(docs, id_col, text_col, length, False)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _removed(docs: DataFrame, id_col: str, text_col: str, length: int, texts_too: bool) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    workers(spark)
    scratch = Scratch(spark)
    gram = min(GRAM, length // 8 * 8)
    if gram < 8:
        raise ValueError("length must be 8 or more")
    rows = strip_to(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    texts = rows.select(F.unhex(F.md5("text")).alias("dig"), "text")
    narrow = scratch.save(rows.select("id", F.unhex(F.md5("text")).alias("dig"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "narrow")
    copied = scratch.save(narrow.where(F.col("n_bytes") >= length).groupBy("dig").count().where("count > 1").select("dig"), "copied")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digs, found = b.column(0).to_pylist(), []
            for t in b.column(1):
                found.append(runs(t.as_py().encode("utf-8", "surrogatepass"), length, gram))
            lens = [len(f[0]) for f in found]
            v, start, windows, again = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 4
            dig = b.column(0).take(pa.array(np.repeat(np.arange(len(digs)), lens)))
            yield pa.RecordBatch.from_arrays([dig, pa.array(v), pa.array(start.astype(np.int64)), pa.array(windows.astype(np.int32)), pa.array(again.astype(bool))], names=["dig", "v", "start", "windows", "again"])

    long_texts = texts.where(F.octet_length("text") >= length)
    raw = scratch.save(long_texts.mapInArrow(find, "dig binary, v long, start long, windows int, again boolean"), "runs")
    lone = small(scratch, "copied", copied)
    once = raw.join(lone, "dig", "left_anti").unionByName(raw.join(lone, "dig", "left_semi").distinct())
    size = F.col("windows") + F.lit(length - 1)
    shared = once.groupBy("v").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.sum(size).alias("bytes")).where("n > 1 or again")
    shared = shared.select("v", F.ceil(F.col("bytes") / GROUP_BYTES).cast("int").alias("arrays"))
    work = scratch.save(split_join(once, shared, ["v"]).select("dig", "v", "start", "windows", "arrays"), "work")
    scratch.drop("runs")

    wanted = scratch.save(work.select("dig").distinct(), "wanted")
    held = long_texts.join(small(scratch, "wanted", wanted), "dig", "left_semi").dropDuplicates(["dig"])
    lists = work.groupBy("dig").agg(F.collect_list(F.struct("v", "start", "windows", "arrays")).alias("runs"))
    held = scratch.save(held.join(lists, "dig"), "held")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "salt", "dig", "start", "windows", "several", "bytes"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for b in batches:
            out: list[tuple] = []
            filled = 0
            for dig, text, found in zip(b.column(0), b.column(1), b.column(2)):
                dig, data = dig.as_py(), text.as_py().encode("utf-8", "surrogatepass")
                for r in found.as_py():
                    start, arrays = r["start"], r["arrays"]
                    # Runs of a large group are dealt by text and place.
                    salt = 0 if arrays == 1 else (int.from_bytes(dig[:8], "little") + start // PIECE + 31 * start) % arrays
                    piece = data[start : start + r["windows"] + length - 1]
                    out.append((r["v"], salt, dig, start, r["windows"], arrays > 1, piece))
                    filled += len(piece)
                    if filled > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out, filled = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    total = work.agg(F.sum(size)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)
    pieces = held.select("dig", "text", "runs").mapInArrow(cut, "v long, salt int, dig binary, start long, windows int, several boolean, bytes binary")
    pieces = pieces.repartition(parts, "v", "salt").sortWithinPartitions("v", "salt")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dig", "first", "last", "key", "repeated"]

        def settle(group: list[tuple]) -> pa.RecordBatch:
            # Equal runs are one text of the array, all of whose windows are repeated.
            alike: dict[bytes, list[tuple]] = {}
            for g in group:
                alike.setdefault(g[6], []).append(g)
            held = list(alike.values())
            text, offset, same, repeated = window_classes(list(alike), [h[0][4] for h in held], length)
            repeated |= np.array([len(h) > 1 for h in held])[text]
            out = [(g[2], g[3] + a, g[3] + z, None, True) for t, a, z in _spans(text[repeated], offset[repeated], length) for g in held[t]] if repeated.any() else []
            # One window of each class of a group with other arrays: it may be repeated there.
            several = np.array([h[0][5] for h in held])
            for k in np.flatnonzero(~same & several[text]).tolist():
                g, at = held[text[k]][0], int(offset[k])
                out.append((g[2], g[3] + at, g[3] + at + length, hashlib.blake2b(g[6][at : at + length], digest_size=16).digest(), bool(repeated[k])))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

        group: list[tuple] = []
        filled = 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if filled >= ARRAY_BYTES and row[:2] != group[-1][:2]:
                    yield settle(group)
                    group, filled = [], 0
                group.append(row)
                filled += len(row[6])
        if group:
            yield settle(group)

    marks = scratch.save(pieces.mapInArrow(sort, "dig binary, first long, last long, key binary, repeated boolean"), "marks")
    spans = marks.where("key is null").select("dig", "first", "last")
    across = marks.where("key is not null")
    elsewhere = across.groupBy("key").count().where("count > 1").select("key")
    met = split_join(across.where("not repeated"), elsewhere, ["key"], "left_semi").select("dig", "first", "last")
    # A class that isn't repeated in its array has one window there, so that no other is missed.
    spans = spans.unionByName(met).groupBy("dig").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dig", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
        for b in batches:
            out = []
            for dig, text, found in zip(b.column(0), b.column(1), b.column(2)):
                data, merged = text.as_py().encode("utf-8", "surrogatepass"), []
                for a, z in sorted((r["first"], r["last"]) for r in found.as_py()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                at, kept = 0, []
                for a, z in merged:
                    kept.append(data[at:a])
                    at = z
                left = b"".join([*kept, data[at:]])
                out.append((dig.as_py(), len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left, [{"first": a, "last": z} for a, z in merged]))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    schema = "dig binary, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<first: long, last: long>>"
    changed = held.select("dig", "text").join(spans, "dig").mapInArrow(clean, schema)
    changed_digests = scratch.save(changed.select("dig", "n_removed", "n_spans", "kept_sha256"), "changed")
    if not texts_too:
        scratch.drop_all(but=("narrow", "copied", "changed"))
    short = changed_digests.join(copied, "dig", "left_anti").withColumn("all", F.lit(False))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    gone = copied.select("dig", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept_sha256"), F.lit(True).alias("all"))
    out = split_join(narrow, short.unionByName(gone), ["dig"], "left")
    n = F.when(F.col("all"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    out = out.select("id", "dig", "n_bytes", n.alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    return out, changed


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, removed, kept) of rows that lose bytes: the removed runs and the bytes that stay."""
    out, changed = _removed(docs, id_col, text_col, length, True)
    some = split_join(out.where("n_removed > 0").select("id", "dig", "n_bytes", "n_removed"), changed.select("dig", "removed", "kept"), ["dig"], "left")
    every = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("last")))
    whole = F.col("n_removed") == F.col("n_bytes")
    return some.select(F.col("id").alias(id_col), "n_bytes", F.when(whole, every).otherwise(F.col("removed")).alias("removed"), F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
