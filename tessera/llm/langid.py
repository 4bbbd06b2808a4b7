"""Language identification by rank-order profiles.

A profile holds the most frequent n-grams (1 to 3 letters, with a mark at word ends) of all texts
of a language in rank order.  A document's own most frequent n-grams are compared to each profile
by the out-of-place distance: the sum of rank differences, a missing n-gram counting as the
profile's length.  Counts are over whole texts, in learning and in prediction.

Defined results: a null text, or one without a letter, is "und" with score 0, and so is every text
if nothing was learned.  Equal counts rank by code points, equal distances by the language's name.
Languages that are null teach nothing.  Repeated rows count as often as they come.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import workers, strip_to

#: N-grams of a profile.
PROFILE = 300
UNKNOWN = "und"
#: N-grams that a task gathers before it counts them.
GATHER = 4_000_000
#: Partitions whose best n-grams meet on the driver: with languages and PROFILE a bound on what it gets.
MERGE_PARTITIONS = 32
_PAD = 1


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, and _PAD for what isn't a letter."""
    table = np.full(0x110000, _PAD, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(text: str | None) -> np.ndarray:
    """All n-grams of a text, packed in 21 bits a letter; empty without a letter."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    seq = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    seq = np.concatenate(([np.uint32(_PAD)], seq, [np.uint32(_PAD)]))
    keep = np.ones(len(seq), dtype=bool)
    keep[1:] = (seq[1:] != _PAD) | (seq[:-1] != _PAD)
    s = seq[keep].astype(np.uint64)
    if len(s) < 2:
        return np.empty(0, dtype=np.uint64)
    shift = np.uint64(21)
    two = (s[:-1] << shift) | s[1:]
    three = (two[:-1] << shift) | s[2:]
    return np.concatenate((s[s != _PAD], two, three[s[1:-1] != _PAD]))


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order, and their counts."""
    g = np.sort(grams)
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, dtype=np.int64)
    return g[starts], np.diff(np.append(starts, len(g)))


def _top(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:k]]


@dataclass
class Profiles:
    """Profiles of all languages: known n-grams in order, and their rank in each language."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, ranked: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(ranked)
        grams = np.unique(np.array([g for r in ranked.values() for g in r], dtype=np.uint64))
        ranks = np.full((len(languages), len(grams) + 1), -1, dtype=np.int64)
        for i, name in enumerate(languages):
            ranks[i, np.searchsorted(grams, np.array(ranked[name], dtype=np.uint64))] = np.arange(len(ranked[name]))
        return cls(languages, grams, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        own = _top(*counted(grams), self.size)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        there = self.ranks[:, at]
        far = np.where(there < 0, self.size, np.abs(there - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.languages[best], float(1 - far[best] / (self.size * len(own)))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from every row with a language, by counts over all of their texts."""
    workers(docs.sparkSession)
    rows = strip_to(docs, lang=lang_col, text=text_col).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        n = 0

        def settle() -> None:
            for lang, parts in waiting.items():
                grams, counts = counted(np.concatenate(parts))
                if lang in held:
                    both = np.concatenate((held[lang][0], grams))
                    grams, where = np.unique(both, return_inverse=True)
                    counts = np.bincount(where, weights=np.concatenate((held[lang][1], counts))).astype(np.int64)
                held[lang] = grams, counts
            waiting.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                g = ngrams(text.as_py())
                waiting.setdefault(lang, []).append(g)
                n += len(g)
                if n >= GATHER:
                    settle()
                    n = 0
        settle()
        for lang, (grams, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = pd.DataFrame({"lang": [], "gram": [], "n": []})
        for f in frames:
            top = pd.concat([top, f]).sort_values(["lang", "n", "gram"], ascending=[True, False, True]).groupby("lang", sort=False).head(size)
        if len(top):
            yield top.astype({"gram": "int64", "n": "int64"})

    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Every partition cuts its counts to the most frequent ones before few tasks merge them.
    form = "lang string, gram long, n long"
    found = totals.mapInPandas(best, form).repartition(MERGE_PARTITIONS).mapInPandas(best, form).collect()
    ranked: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (r.lang, -r.n, r.gram)):
        if len(own := ranked.setdefault(r.lang, [])) < size:
            own.append(r.gram)
    return Profiles.of(ranked, size)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """(id, also, lang_pred, score) of every row; also: columns that only go along."""
    workers(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *[c.alias(n) for n, c in (also or {}).items()], F.col(f"`{text_col}`").alias("_text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t.as_py()) for t in b.column(len(kept))]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], *made], names=[*kept, "lang_pred", "score"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]] + ["lang_pred string", "score double"])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
