"""The corpus pipeline against a brute-force version of its stages."""

import hashlib
import random

import pytest

import corpus_pipeline
from tessera.llm import contract, quality


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(n))
    rows = [(i, prose(12), "en", f"s{i % 4}" if i % 3 else "s0", 1) for i in range(240)]
    for k in range(30):  # exact copies
        rows.append((1000 + k, rows[k][1], "en", "s1", 1))
    for k in range(30, 60):  # near copies
        w = rows[k][1].split(" ")
        w[rng.randrange(len(w))] = "Changed"
        rows.append((1000 + k, " ".join(w), "en", "s2", 1))
    rows += [(2000 + i, " ".join(word() + "###" for _ in range(80)), "en", "s3", 1) for i in range(40)]
    rows += [(3000, None, "en", None, 0), (3001, "", None, "s1", 0), (None, rows[0][1], "en", "s0", 1)]
    return rows


def test_stages(spark, corpus, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(corpus, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]

    kept = seen["quality_classifier"]
    model = quality.fit(spark.createDataFrame(corpus, schema))
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in corpus if model.scorer.score(r[1]) >= 0.5)
    ids = {r.doc_id for r in kept}
    assert set(range(240)) <= ids and not any(i and i >= 2000 for i in ids)

    low = lambda i: -1 if i is None else i
    first = {}
    for r in kept:
        first[r.text] = min(first.get(r.text, 1 << 60), low(r.doc_id))
    assert sorted((low(r.doc_id), r.text) for r in seen["exact_dedup"]) == sorted((i, t) for t, i in first.items())

    def shingles(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    # One of each near-duplicate pair goes, the one of the larger id, and no other.
    before = sorted(seen["exact_dedup"], key=lambda r: low(r.doc_id))
    stay = []
    for r in before:
        s = shingles(r.text)
        if not any(len(s & t) >= 0.8 * len(s | t) for _, t in stay):
            stay.append((low(r.doc_id), s))
    got = {low(r.doc_id) for r in seen["simhash_near_dedup"]}
    assert {i for i, _ in stay} <= got and len(got) - len(stay) <= 3

    size, took = {}, {}
    for r in seen["simhash_near_dedup"]:
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    for r in seen["mixing"]:
        took[r.source] = took.get(r.source, 0) + len(r.text.split())
    from .test_mixing_langid import brute_targets

    for s, t in brute_targets(size).items():
        assert abs(took.get(s, 0) - t) <= max(5, 0.02 * t)

    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(contract.vocabulary())
    want = []
    for r in seen["mixing"]:
        e = lib.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(e), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e)).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, seen["bpe"]))) == sorted(map(str, want))

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, seen["bpe"]))


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
