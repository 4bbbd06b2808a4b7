"""The prefixes of the pipeline's near duplicates are exchanged once, packed, and none is lost by that."""

import random
from collections import Counter

import pytest

from tessera.llm import shared, simhash

from .test_near_dedup import brute, changed


def written(spark):
    """Bytes of shuffle files that this session has written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    made = sc.statusStore().executorList(False)
    return sum(made.apply(i).totalShuffleWrite() for i in range(made.size()))


def test_bytes_exchanged(spark, monkeypatch):
    """As at size, where no table is small enough to be broadcast."""
    for module in (shared, simhash):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    rng = random.Random(21)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(600)]
    texts.append(changed(rng, texts[0], 3))  # else there is nothing to join
    values = sum(len(simhash.prefix(simhash.shingle_set(t, 5), 0.8, *[simhash.np.array([], d) for d in ("<u8", "<i8")])) for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    monkeypatch.setattr(simhash, "SAMPLE", 20)  # else the sample that orders shingles is the whole table
    seen, save, known = {}, shared.Scratch.save, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def watched(scratch, df, name):
        out = save(scratch, df, name)
        seen[name] = written(spark)
        return out

    monkeypatch.setattr(shared.Scratch, "save", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert simhash.dedup(docs).count() == len(texts) - 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    each = (seen["post0"] - seen["made"]) / values
    print("bytes exchanged a value of a prefix", each)
    assert each < 14


@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_values_of_more_than_one_row(spark, buckets):
    rng = random.Random(22)
    rows = [1, 2, 3, 70_000, (1 << 33) + 5, (1 << 33) + 6, (7 << 33) + 5, (1 << 40) + 1, 9, 10]
    lists = {r: rng.sample([*range(-40, 60), -(1 << 63), (1 << 63) - 1], 20) for r in rows} | {9: [], 10: [10**12]}
    lists |= {r: lists[r] + [10**15] for r in rows[:9]}
    counts = Counter(v for vs in lists.values() for v in vs)
    got = simhash.meeting(spark.createDataFrame(list(lists.items()), "row long, list array<long>").coalesce(2), buckets).collect()
    assert sorted((r.row, r.value) for r in got) == sorted((r, v) for r, vs in lists.items() for v in vs if counts[v] > 1)
    assert len(got) > 100


def test_rows_far_apart_in_a_batch(spark):
    rows = [(0, [5, 6]), (1 << 20, [5]), ((1 << 32) + 3, [6, 7])]
    got = simhash.meeting(spark.createDataFrame(rows, "row long, list array<long>").coalesce(1), 1).collect()
    assert sorted((r.row, r.value) for r in got) == [(0, 5), (0, 6), (1 << 20, 5), ((1 << 32) + 3, 6)]


def test_no_lists(spark):
    assert simhash.meeting(spark.createDataFrame([(1, [])], "row long, list array<long>"), 3).count() == 0


def test_small_buckets_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 50)
    rng = random.Random(23)
    prose = lambda n: " ".join(f"t{rng.randrange(2000)}" for _ in range(n))
    passage, texts = prose(60), [" ", "\n\n", "\t"]
    for _ in range(40):
        t = prose(90)
        texts += [t, changed(rng, t, 1), changed(rng, t, 2), passage + " " + prose(9), passage + " " + prose(30)]
    rows = list(enumerate(texts))
    got = sorted(r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
