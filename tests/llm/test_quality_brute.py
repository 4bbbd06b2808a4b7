"""The quality classifier against plain versions: EM a document at a time, and a dense regression."""

import math
import random

import numpy as np

from tessera.llm import quality as Q


def plain_em(cast):
    """EM over single documents' votes, without patterns; the smoothing of quality.fit_labels."""
    n = len(cast[0])
    good = [[0.9, 0.5, 0.1][min(2, v.count(str(Q.BAD)))] for v in cast]
    for _ in range(Q.EM_ROUNDS):
        prior = (sum(good) + 1) / (len(cast) + 2)
        rate = {}
        for i in range(n):
            for side in (Q.GOOD, Q.BAD):
                seen = {x: 1.0 for x in (Q.GOOD, Q.BAD)}
                for v, p in zip(cast, good):
                    if int(v[i]) != Q.NONE:
                        seen[int(v[i])] += p if side == Q.GOOD else 1 - p
                for x in seen:
                    rate[i, side, x] = seen[x] / sum(seen.values())
        new = []
        for v in cast:
            odds = math.log(1 - prior) - math.log(prior)
            for i, x in enumerate(map(int, v)):
                if x != Q.NONE:
                    odds += math.log(rate[i, Q.BAD, x]) - math.log(rate[i, Q.GOOD, x])
            new.append(1 / (1 + math.exp(max(-500, min(500, odds)))))
        if max(abs(a - b) for a, b in zip(new, good)) < 1e-9:
            good = new
            break
        good = new
    return prior, good


def plain_scores(texts, labels):
    """Soft logistic regression on a dense matrix: (score of a text)."""
    x = np.zeros((len(texts), Q.BUCKETS))
    for row, t in zip(x, texts):
        np.add.at(row, *Q.hashed(t))
    y = np.array(labels)
    each = np.where(y >= 0.5, 0.5 / (y >= 0.5).sum(), 0.5 / (y < 0.5).sum())
    w, b, sw, sb = np.zeros(Q.BUCKETS), 0.0, np.full(Q.BUCKETS, 1e-8), 1e-8
    for _ in range(Q.EPOCHS):
        err = each * (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - y)
        grad = x.T @ err + Q.RIDGE * w
        sw, sb = sw + grad**2, sb + err.sum() ** 2
        w, b = w - Q.STEP * grad / np.sqrt(sw), b - Q.STEP * err.sum() / math.sqrt(sb)
    row = np.zeros(Q.BUCKETS)

    def score(text):
        row[:] = 0
        np.add.at(row, *Q.hashed(text))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, row @ w + b))))

    return score


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrd") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(n)) + "."
    junk = [lambda: " ".join(word() + "###" for _ in range(40)), lambda: prose(6).upper().replace(" ", "!! "), lambda: " ".join([word()] * 90), lambda: " | ".join(word() for _ in range(40))]
    return [prose(rng.randrange(1, 9)) for _ in range(150)] + [junk[i % 4]() for i in range(50)]


def test_equals_plain_versions(spark):
    texts = corpus(7)
    texts += texts[:20] + [texts[-1]] * 30  # copies count in EM, and once in the sample
    cast = [Q.votes(t) for t in texts]
    prior, good = plain_em(cast)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, " "])], "doc_id long, text string")
    model = Q.fit(docs, sample=10_000)
    assert abs(model.labels.prior - prior) < 1e-6
    assert set(model.labels.posterior) == set(cast)
    assert max(abs(model.labels.posterior[v] - p) for v, p in zip(cast, good)) < 1e-6
    clear = {t: p for t, p in zip(texts, good) if abs(p - 0.5) >= 0.4}
    score = plain_scores(list(clear), list(clear.values()))
    got = {r.doc_id: r for r in Q.judge(docs, model).collect()}
    assert max(abs(got[i].score - score(t)) for i, t in enumerate(texts)) < 1e-3
    assert all(got[i].kept == (score(t) >= 0.5) for i, t in enumerate(texts) if abs(score(t) - 0.5) > 1e-3)
    assert [(got[i].score, got[i].kept) for i in (len(texts), len(texts) + 1)] == [(0.0, False)] * 2
