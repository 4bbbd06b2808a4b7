"""Near duplicates against a search of all pairs."""

import random

import numpy as np
import pytest

from tessera.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def brute(rows):
    """Ids that stay when each row, by id, is held against all that stay before it."""
    stay = []
    for i, t in sorted(rows):
        s = shingles(t)
        if not any(len(s & k) >= 0.8 * len(s | k) for _, k in stay):
            stay.append((i, s))
    return [i for i, _ in stay]


def kept(spark, rows):
    return sorted(r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def changed(rng, text, n):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_many_unlike_texts_of_the_same_words(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(words + [rng.choice(words) for _ in range(90)]) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):  # one word becomes another of the same twelve
        w = t.split()
        w[50] = words[(words.index(w[50]) + 1) % 12]
        rows.append((100 + i, " ".join(w)))
    assert len({simhash.fingerprint(t, 1, distinct=True) for _, t in rows}) == 1
    assert kept(spark, rows) == brute(rows) == list(range(30))


def test_copy_of_a_row_that_has_a_close_copy(spark):
    """The fingerprints of b and c differ in 3 to 5 bits, but the smaller one of a, 2 bits from b at most, in more from c."""
    rng = random.Random(2)
    fp = lambda t: simhash.fingerprint(t, 1, distinct=True)
    bits = lambda x, y: ((fp(x) ^ fp(y)) % (1 << 64)).bit_count()
    near = lambda x, y: len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))
    for _ in range(500):
        b = " ".join(f"v{rng.randrange(10**9)}" for _ in range(150))
        made = [changed(rng, b, 2) for _ in range(40)]
        found = [(a, c) for a in made if bits(a, b) <= 2 and fp(a) < fp(b) for c in made if 3 <= bits(b, c) <= 5 < bits(a, c) and near(b, c)]
        if found:
            break
    a, c = found[0]
    rows = [(1, b), (2, a), (3, c)]
    assert kept(spark, rows) == brute(rows) == [1]


@pytest.mark.parametrize("pairs", [simhash.PAIRS, -1, 10**9])
def test_equals_search_of_all_pairs(spark, monkeypatch, pairs):
    """By leaders and pairs, by leaders as far as they go, and by pairs alone."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(3)
    words = [f"t{k}" for k in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, passage = [], prose(40)
    for n, most, copies in ((100, 2, 60), (600, 14, 40), (40, 1, 20), (7, 1, 10)):
        for _ in range(copies):
            t = prose(n)
            rows += [t, changed(rng, t, most), changed(rng, t, rng.randrange(1, most + 1))]
            rows.append(t + " " + prose(n // 5))
    rows += [passage + " " + prose(60) for _ in range(40)] + [passage + " " + prose(11) for _ in range(20)]
    for _ in range(2):  # chains, in which each text is near the next only
        t = prose(120)
        for _ in range(30):
            rows.append(t)
            t = changed(rng, t, 2)
    base = prose(80)
    rows += [changed(rng, base, 1) for _ in range(150)] + ["", " ", "\n ", "a b", "A  b", "a c"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert kept(spark, rows) == brute(rows)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    none = np.array([], dtype="<u8"), np.array([], dtype=np.int64)
    for n in range(1, 60):
        pool = np.unique(rng.integers(1, 1 << 62, 3 * n).astype("<u8"))
        for common, ranks in (none, (pool[::3], np.arange(len(pool[::3])) % 5 + 3)):
            for _ in range(20):
                x = np.sort(rng.choice(pool, n, replace=False))
                y = np.unique(np.concatenate([x[rng.random(n) < 0.9], rng.choice(pool, max(1, n // 12))]))
                if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
                    assert len(np.intersect1d(simhash.prefix(x, 0.8, common, ranks), simhash.prefix(y, 0.8, common, ranks)))
