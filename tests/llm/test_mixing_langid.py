"""Mixing and language identification on small tables."""

import random
import zlib

import pytest

from tessera.llm import langid, mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("n", [300, 4000])
def test_mixture(spark, n):
    rng = random.Random(n)
    names = ["b", "a", None, "é", "empty", "tiny"]
    rows = []
    for i in range(n):
        s = rng.choice(names[:4]) if rng.random() < 0.66 else "a"
        rows.append((i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60) if rng.random() < 0.99 else 3000)), s, 7))
    rows += [(n, None, "empty", 1), (n + 1, "", "empty", 1), (n + 2, " x y\x1cz ", "tiny", 1), (None, "q r", "a", 1), (None, "q r", "a", 1), (5, rows[5][1], rows[5][2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    want = brute_targets(size)
    source = {i: s for i, _, s, _ in rows}
    source[None] = "a"
    taken = dict.fromkeys(size, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) or s == "tiny"
    first, again = (mixing.mixture(d).collect() for d in (docs, docs.repartition(3)))
    assert sorted(map(str, first)) == sorted(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = {s: 0 for s in size}
    for r in mixed.collect():
        words[r.source] += len((r.text or "").encode().split())
    assert all(abs(words[s] - want[s]) <= max(2, 0.01 * want[s]) or s == "tiny" for s in size)
    assert mixing.mixture(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_copies_are_dealt_to_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    flight = mixing._flight

    def watched(seed, level):
        run = flight(seed, level)

        def checked(key, f):
            assert len(f) < 2 * mixing.CHUNK
            return run(key, f)

        return checked

    monkeypatch.setattr(mixing, "_flight", watched)
    rows = [(7, "one two three", "a", "k")] * 5000 + [(None, "one two", "b", "k")] * 5000 + [(i, "w " * (i % 9), "c", str(i % 2)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    size = {"a": 15000, "b": 10000, "c": sum(i % 9 for i in range(500))}
    want = brute_targets(size)
    mixed = mixing.mix(docs).collect()
    words = dict.fromkeys(size, 0)
    for r in mixed:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - want[s]) <= 0.01 * want[s] + 3 for s in size)
    assert sum(r.taken for r in got) == sum(words.values())
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_flight_keeps_totals():
    rng = random.Random(2)
    x = [float(rng.randrange(1, 500)) for _ in range(400)]
    p = [0.37] * 400
    q = list(p)
    mixing.fly(x, q, rng)
    assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(x, q)) == pytest.approx(sum(a * b for a, b in zip(x, p)))
    assert sum(0 < v < 1 for v in q) <= 2


def brute_profile(texts, k=300):
    counts = {}
    for t in texts:
        letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else "\x01" for c in t)
        line = "\x01" + "\x01".join(w for w in letters.split("\x01") if w) + "\x01"
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                g = line[i : i + n]
                if (n == 1 and g != "\x01") or n == 2 or (n == 3 and g[1] != "\x01"):
                    counts[g] = counts.get(g, 0) + 1
    if list(counts) == ["\x01\x01"]:
        return []
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:k]


def test_language(spark):
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(40))
    alphabets = {"aa": "abcdeaae", "bb": "bdgoéöobb", "cc": "дежзиде"}
    rows = [(i, make(alphabets[lang]), lang, 0.5) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(200, None, "aa", 0.0), (201, "", "bb", 0.0), (202, "12 !?", None, 0.0), (203, "ИЖЕ, дед", None, 0.0), (None, "ab ea", "aa", 0.0), (0, rows[0][1], "aa", 0.0), (204, "语言" * 3000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    from pyspark.sql import functions as F

    out = langid.held_out(F.col("doc_id"))
    profiles = langid.fit(docs.where(~out))
    hidden = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert profiles.languages == ["aa", "bb", "cc"]
    ranked = {lang: brute_profile([t for i, t, k, _ in rows if k == lang and t and not hidden(i)]) for lang in profiles.languages}
    got = langid.predict(docs, profiles, also={"held_out": out}).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _, _ in rows}
    right = 0
    for r in got:
        own = brute_profile([text[r.doc_id] or ""])
        assert r.held_out == hidden(r.doc_id) and 0 <= r.score <= 1
        if not own or not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        far = {lang: sum(abs(k - ranked[lang].index(g)) if g in ranked[lang] else 300 for k, g in enumerate(own)) for lang in ranked}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert r.lang_pred == best and r.score == pytest.approx(1 - far[best] / (300 * len(own)))
        right += r.doc_id is not None and r.doc_id < 90 and r.lang_pred == rows[r.doc_id][2]
    assert right >= 90
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), profiles).count() == 0
