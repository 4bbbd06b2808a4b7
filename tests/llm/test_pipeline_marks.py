"""The pipeline's near duplicates go through fingerprints first, and what these find isn't looked for again."""

import random

import corpus_pipeline
from tessera.llm import simhash

from .test_near_dedup import brute, changed


def corpus():
    rng = random.Random(12)
    prose = lambda n: " ".join(f"t{rng.randrange(3000)}" for _ in range(n))
    texts = []
    for _ in range(40):
        t = prose(150)
        texts += [t, changed(rng, t, 1), changed(rng, t, 3)]
    return list(enumerate(texts))


def test_fingerprints_give_pairs(spark, monkeypatch):
    rows, seen, links = corpus(), [], simhash.links

    def watched(fps, distance, groups):
        found = links(fps, distance, groups)
        seen.append((fps.count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "links", watched)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    print("fingerprints and their links", seen)
    assert got == brute(rows)
    assert len(seen) == 1 and seen[0][0] > 40 and seen[0][1] > 10


def test_first_row_near_each_fingerprint(spark):
    from tessera.llm.shared import Scratch

    marks = [(5, 10, 0b111), (2, 10, 0b011), (9, 10, 0b111), (7, 10, 1 << 40), (1, 3, 0b1), (8, 10, 0b11111)]
    got = simhash._first_alike(spark.createDataFrame(marks, "num long, size int, fp long"), Scratch(spark), 0.8).collect()
    # 1 is the first near all others but 8, and too short for them; 5 is the first near 8.
    assert [(r.a, r.b) for r in got] == [(5, 8)]
