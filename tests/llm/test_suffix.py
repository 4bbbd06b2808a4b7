"""Two-stage suffix sorting and the removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcd", bytes(range(256))])
def test_suffix_order(letters):
    rng = random.Random(len(letters))
    for _ in range(20):
        texts = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(1, 6))]
        texts += [texts[0][3:] or b"a"]
        order, s, begins = S.suffix_order(texts, 30)
        assert sorted(order.tolist()) == np.flatnonzero(s).tolist()
        where = np.searchsorted(begins, order, side="right") - 1
        keys = [texts[t][i - begins[t] :][:30] for t, i in zip(where.tolist(), order.tolist())]
        assert keys == sorted(keys)


def test_runs():
    rng = random.Random(1)
    for text in [b"x" * 40_000, bytes(rng.choice(b"ab") for _ in range(3000)), b"line of text\n" * 900, bytes(rng.randrange(256) for _ in range(2000)), b"short"]:
        v, start, windows, again = S.runs(text, 64, 32)
        assert windows.sum() == max(0, len(text) - 63) and (windows <= S.PIECE).all()
        by = {}
        for a, b, n in zip(v.tolist(), start.tolist(), windows.tolist()):
            for i in range(b, b + n):
                assert by.setdefault(text[i : i + 64], a) == a  # equal windows share a minimizer


def brute(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("group", [256 << 10, 600])
def test_removed(spark, group, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", group)
    monkeypatch.setattr(S, "ARRAY_BYTES", group)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = text(rng.randrange(0, 60))
        if rng.random() < 0.5:
            t += rng.choice(shared)[rng.randrange(20) : 140 - rng.randrange(20)] + text(20)
        texts.append(t)
    texts += [None, "", "x" * 5000, "line again\n" * 200, shared[0], shared[0], texts[3], texts[3], "ab" * 40 + "q" + "ab" * 40, "z" * 63, "z" * 64, text(4000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1), (None, "no id " + shared[1], 1)], "doc_id long, text string, n_bytes int")
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "no id " + shared[1])]
    want = brute([(t or "").encode() for _, t in rows], 64)
    got = S.removed(docs, length=64).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w[:4])) for (i, _), w in zip(rows, want))
    kept = {str((r.doc_id, bytes(r.kept), sum(x["last"] - x["first"] for x in r.removed), len(r.removed))) for r in S.spans(docs, length=64).collect()}
    assert kept == {str((i, w[4], w[1], w[2])) for (i, _), w in zip(rows, want) if w[1]}
    assert S.removed(docs.limit(0), length=64).count() == 0
