"""Quality classifier: weak labels by expectation-maximisation train a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every document.  Votes are counted by pattern (at
most 3 to the power of the labellers, so a bounded table whatever the corpus), and EM estimates from
all of them the prior, and for each labeller how often it votes what on good and on bad documents.
The posterior of its pattern labels a document.  A logistic regression on hashed byte n-grams learns
from a bounded sample of labelled documents (SAMPLE, those with the smallest hashes of each side)
and scores every whole text.

Defined results: a null or blank text scores 0 and is rejected.  Repeated rows score alike.  An
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
import operator
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, strip_to, workers

#: Documents that the scorer learns from, half of them good and half bad where there are as many.
SAMPLE = 4000
#: Hashed features, and bytes of an n-gram.
BUCKETS, GRAM = 1 << 14, 4
#: Passes over the sample, step and ridge of the regression.
EPOCHS, STEP, RIDGE = 60, 1.0, 1e-5
#: Documents whose gradient is taken at once.
PART = 256
EM_ROUNDS = 200
GOOD, BAD, NONE = 1, 0, 2


def _share(n: float, of: float) -> float:
    return n / of if of else 0.0


def _bands(value: float, good: float, bad: float) -> int:
    """Good up to the first bound, bad from the second on, nothing between."""
    return GOOD if value <= good else BAD if value >= bad else NONE


#: Marks that are rare in prose.
SYMBOLS = "#$%&*|<>{}[]\\^~=_@+"
_OTHER, _LETTER, _UPPER, _SPACE, _DIGIT, _SYMBOL, _SHOUT = range(7)


@functools.cache
def _classes() -> np.ndarray:
    """The kind of each code point."""
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = _UPPER if ch.isupper() else _LETTER
        elif ch.isspace():
            table[c] = _SPACE
        elif ch.isalnum():
            table[c] = _DIGIT
    table[[ord(c) for c in SYMBOLS]] = _SYMBOL
    table[ord("!")] = _SHOUT
    return table


def features(text: str) -> dict[str, float]:
    """What labellers and scorer look at, over the whole text; all but words are shares."""
    kinds = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    n = np.bincount(kinds, minlength=7).tolist()
    inside = np.concatenate(([False], kinds != _SPACE, [False]))
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:])
    words = len(starts)
    letters = n[_LETTER] + n[_UPPER]
    solid = (kinds == _LETTER) | (kinds == _UPPER) | (kinds == _DIGIT)
    bare = int((~np.logical_or.reduceat(solid, starts)).sum()) if words else 0
    tokens = text.split()
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    return {
        "words": words,
        "symbols": _share(n[_SYMBOL], words),
        "upper": _share(n[_UPPER], letters),
        "shouts": _share(n[_SHOUT], words),
        "letters": _share(letters, letters + n[_SYMBOL] + n[_SHOUT] + n[_OTHER]),
        "odd_ends": _share(int((kinds[ends] == _SYMBOL).sum()), words),
        "repeats": 1 - _share(len(set(lines)), len(lines)),
        "bare": _share(bare, words),
        "stutter": _share(sum(map(operator.eq, tokens, tokens[1:])), words),
        "stale_pairs": 1 - _share(len(set(zip(tokens, tokens[1:]))), len(tokens) - 1) if len(tokens) > 1 else 0.0,
        "packs": 1 - min(1.0, _share(len(zlib.compress(raw, 1)), len(raw))) if (raw := text.encode("utf-8", "surrogatepass")) else 0.0,
    }


@dataclass(frozen=True)
class Labeller:
    name: str
    vote: Callable[[dict[str, float]], int]


#: Bounds between which a labeller abstains; they don't depend on the corpus.
LABELLERS = (
    Labeller("symbols", lambda f: _bands(f["symbols"], 0.05, 0.25)),
    Labeller("upper", lambda f: _bands(f["upper"], 0.15, 0.5)),
    Labeller("shouts", lambda f: _bands(f["shouts"], 0.02, 0.2)),
    Labeller("letters", lambda f: GOOD if f["letters"] >= 0.9 else BAD if f["letters"] <= 0.7 else NONE),
    Labeller("odd_ends", lambda f: _bands(f["odd_ends"], 0.02, 0.3)),
    Labeller("stutter", lambda f: _bands(f["stutter"], 0.05, 0.3)),
    Labeller("stale_pairs", lambda f: _bands(f["stale_pairs"], 0.5, 0.75)),
    Labeller("packs", lambda f: _bands(f["packs"], 0.75, 0.88)),
    Labeller("bare", lambda f: _bands(f["bare"], 0.01, 0.12)),
)


def votes(text: str | None, labellers: tuple[Labeller, ...] = LABELLERS, f: dict[str, float] | None = None) -> str | None:
    """One digit a labeller; null for a blank text."""
    if text is None or not text.strip():
        return None
    f = f or features(text)
    return "".join(str(x.vote(f)) for x in labellers)


@dataclass
class LabelModel:
    """What EM has found: the share of good documents and each labeller's votes on either side."""

    prior: float
    table: np.ndarray  # labeller, side, vote (bad, good): how often it votes so when it votes
    posterior: dict[str, float]


def fit_labels(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> LabelModel:
    """EM over the counts of vote patterns.

    Labellers are taken as independent given the side, and no vote as no evidence.  At the start two
    bad votes make a document bad, as labellers of other faults than its own all call it good.
    Counts are smoothed by one document of each kind.
    """
    if not patterns:
        return LabelModel(0.5, np.empty((0, 2, 2)), {})
    keys = sorted(patterns)
    v = np.array([[int(c) for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], dtype=float)
    good = np.array([0.9, 0.5, 0.1])[np.minimum((v == BAD).sum(axis=1), 2)]
    prior, table = 0.5, np.full((v.shape[1], 2, 3), 1.0)
    for _ in range(rounds):
        prior = (n @ good + 1) / (n.sum() + 2)
        for i in range(v.shape[1]):
            for side, weight in ((GOOD, good), (BAD, 1 - good)):
                counts = np.bincount(v[:, i], weights=n * weight, minlength=3)[:NONE] + 1
                table[i, side, :NONE] = counts / counts.sum()  # no vote is no evidence
        logs = np.log(table)
        a = math.log(prior) + sum(logs[i, GOOD, v[:, i]] for i in range(v.shape[1]))
        b = math.log(1 - prior) + sum(logs[i, BAD, v[:, i]] for i in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
        settled = np.allclose(new, good, atol=1e-9)
        good = new
        if settled:
            break
    return LabelModel(float(prior), table[:, :, :NONE], dict(zip(keys, good.tolist())))


def shape(f: dict[str, float], buckets: int) -> np.ndarray:
    """A bucket for the band of each share, bands growing with the share."""
    bounds = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
    return np.array([zlib.crc32(f"{k}={sum(v > b for b in bounds)}".encode()) % buckets for k, v in f.items() if k != "words"])


def hashed(text: str | None, f: dict[str, float] | None = None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: the logarithms of its byte n-grams' counts, scaled to length one, and its shape."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(raw) < GRAM:
        raw = np.concatenate((raw, np.full(GRAM - len(raw), 32, np.uint8)))
    g = raw[: len(raw) - GRAM + 1].astype(np.uint32)
    for i in range(1, GRAM):
        g = (g << np.uint32(8)) | raw[i : len(raw) - GRAM + 1 + i]
    g = (g * np.uint32(2654435761)) >> np.uint32(32 - (buckets.bit_length() - 1))
    counts = np.bincount(g, minlength=buckets)
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at])
    marks = shape(f or features(text), buckets)
    return np.concatenate((at, marks)), np.concatenate((x / np.sqrt((x * x).sum()), np.full(len(marks), 0.5)))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, f: dict[str, float] | None = None) -> float:
        if text is None or not text.strip():
            return 0.0
        at, x = hashed(text, f, len(self.weights))
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + x @ self.weights[at])))))


def fit_scorer(sample: list[tuple[np.ndarray, np.ndarray, float]], buckets: int = BUCKETS) -> Scorer:
    """Logistic regression on soft labels, both sides weighing the same, by full gradients."""
    w, bias = np.zeros(buckets), 0.0
    if not sample:
        return Scorer(w, 50.0)
    y = np.array([s[2] for s in sample])
    if (y >= 0.5).all() or (y < 0.5).all():
        return Scorer(w, 50.0 if y[0] >= 0.5 else -50.0)  # only one side is known
    each = np.where(y >= 0.5, 0.5 / (y >= 0.5).sum(), 0.5 / (y < 0.5).sum())
    # In parts of a few hundred documents, so that only the features themselves take memory.
    parts = []
    for i in range(0, len(sample), PART):
        some = sample[i : i + PART]
        rows = np.repeat(np.arange(len(some), dtype=np.int32), [len(s[0]) for s in some])
        parts.append((i, len(some), rows, np.concatenate([s[0] for s in some]).astype(np.int32), np.concatenate([s[1] for s in some]).astype(np.float32)))
    square = np.full(buckets, 1e-8)
    square_bias = 1e-8
    for _ in range(EPOCHS):
        grad, total = RIDGE * w, 0.0
        for i, n, rows, cols, vals in parts:
            z = np.bincount(rows, weights=vals * w[cols], minlength=n) + bias
            err = each[i : i + n] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[i : i + n])
            grad += np.bincount(cols, weights=vals * err[rows], minlength=buckets)
            total += err.sum()
        square += grad * grad
        square_bias += total**2
        w -= STEP * grad / np.sqrt(square)
        bias -= STEP * total / math.sqrt(square_bias)
    return Scorer(w, bias)


@dataclass
class Model:
    labels: LabelModel
    scorer: Scorer


def fit(docs: DataFrame, text_col: str = "text", labellers: tuple[Labeller, ...] = LABELLERS, sample: int = SAMPLE) -> Model:
    """Label model over all documents and scorer over at most sample of them."""
    spark = docs.sparkSession
    workers(spark)
    scratch = Scratch(spark)
    texts = strip_to(docs, text=text_col)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [votes(t.as_py(), labellers) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["pick", "votes"])

    cast = scratch.save(texts.select(F.xxhash64("text").alias("pick"), "text").mapInArrow(vote, "pick long, votes string").where("votes is not null"), "votes")
    patterns = {r.votes: r["n"] for r in cast.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    labels = fit_labels(patterns)
    if not patterns:
        return Model(labels, fit_scorer([]))
    # The sample: documents of the clearest patterns on either side, by hash.  Texts come by hash, too.
    sides = {k: p >= 0.5 for k, p in labels.posterior.items() if abs(p - 0.5) >= 0.4}
    chosen: dict[int, float] = {}
    for side in (True, False):
        names = [k for k, s in sides.items() if s == side]
        rows = cast.where(F.col("votes").isin(names)).groupBy("pick").agg(F.first("votes").alias("votes")).orderBy("pick").limit(sample // 2).collect() if names else []
        chosen |= {r.pick: labels.posterior[r.votes] for r in rows}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [hashed(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([at.astype("<i4").tobytes() for at, _ in out], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in out], pa.binary())], names=["pick", "at", "x"])

    wanted = F.broadcast(spark.createDataFrame([(k,) for k in sorted(chosen)], "pick long"))
    # Documents of one text are alike: distinct() keeps one in each task.
    picked = texts.select(F.xxhash64("text").alias("pick"), "text").join(wanted, "pick", "left_semi").distinct()
    rows = picked.mapInArrow(gather, "pick long, at binary, x binary").collect()
    rows.sort(key=lambda r: r.pick)
    return Model(labels, fit_scorer([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4"), chosen[r.pick]) for r in rows]))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, labellers: tuple[Labeller, ...] = LABELLERS) -> DataFrame:
    """(id, votes, weak_label, score, kept) of every row.

    weak_label: the label model's probability that the document is good; null for a blank text.
    """
    workers(docs.sparkSession)
    rows = strip_to(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            looks = [features(t or "") for t in texts]
            cast = [votes(t, labellers, f) for t, f in zip(texts, looks)]
            weak = [None if c is None else model.labels.posterior.get(c, 0.5) for c in cast]
            scores = [model.scorer.score(t, f) for t, f in zip(texts, looks)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cast, pa.string()), pa.array(weak, pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())],
                names=["id", "votes", "weak_label", "score", "kept"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, votes string, weak_label double, score double, kept boolean").withColumnRenamed("id", id_col)


def filter_docs(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least threshold, with all their columns."""
    workers(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: model.scorer.score(t))

    return docs.where(score(F.col(f"`{text_col}`")) >= threshold)
