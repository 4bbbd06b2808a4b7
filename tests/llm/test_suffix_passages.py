"""Planted passages of over 50 words at the query's own length of 400 bytes."""

import hashlib
import random

from tessera.llm import contract

LENGTH = 400


def passage(rng, size):
    """A text of over 50 words and of size bytes, some letters of two bytes."""
    out = " ".join("".join(rng.choice("abcdefghié") for _ in range(rng.randrange(3, 6))) for _ in range(200))
    out = out.encode()[:size].decode(errors="ignore").rstrip()
    out += "x" * (size - len(out.encode()))
    assert len(out.split()) > 50 and len(out.encode()) == size
    return out


def test_planted_passages(spark, tmp_path):
    rng = random.Random(3)
    own = lambda: passage(rng, 600)
    rows, want = [], []

    def plant(parts, spans):
        text = "".join(parts)
        raw = text.encode()
        kept = "".join(p for p, gone in parts.items() if not gone).encode()
        rows.append((len(rows), text))
        want.append((len(want), len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))

    # The marks before and after a passage differ, so that no longer string repeats.
    for k, size in enumerate((LENGTH - 1, LENGTH, LENGTH + 1, 700)):
        shared = passage(rng, size)
        for mark in range(2):
            plant({own() + f"<{k}{mark}": False, shared: size >= LENGTH, f"{mark}{k}>" + own(): False}, int(size >= LENGTH))
    again = passage(rng, LENGTH)
    once = {own() + "<": False, again: True, "> ": False}
    text = "".join(once) + again + "!"  # both places lie in one document
    rows.append((len(rows), text))
    kept = text.replace(again, "").encode()
    want.append((len(want), len(text.encode()), 2 * LENGTH, 2, hashlib.sha256(kept).hexdigest()))
    for _ in range(4):
        plant({own(): False}, 0)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = contract.queries()["op8_suffix_dedup"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want
