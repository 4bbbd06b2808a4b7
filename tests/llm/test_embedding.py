"""The epsilon grid order join against brute force."""

import numpy as np
import pytest

from tessera.llm import embedding_dedup as E

from .test_small import brute_components


@pytest.mark.parametrize("n,d,kind", [(400, 16, "float"), (1600, 24, "double"), (60, 3, "float")])
def test_near_vectors(spark, n, d, kind, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 32)
    rng = np.random.default_rng(n)
    base = rng.normal(size=(12, d))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.12, 0.4])
        v = np.float32(v * rng.choice([1.0, 3.0])) if kind == "float" else v
        rows.append((i, [float(x) for x in v], int(rng.integers(3)), 5))
    bad = [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1)]
    rows += [(n + i, v, 1, 5) for i, v in enumerate(bad)]
    rows += [(n + 20, rows[0][1], None, 5), (n + 21, rows[0][1], rows[0][2], 5), (0, rows[0][1], rows[0][2], 5), (None, rows[3][1], rows[3][2], 5), (n + 22, [1.0, 0.0], 1, 5), (n + 23, [1.0, -0.0], 1, 5), (n + 24, [2.0, 0.0], 1, 5)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, n_links int")
    got = E.near_vectors(df).collect()
    assert len(got) == len(rows)

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(r[1]) for r in rows]
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if rows[a][2] is not None and rows[a][2] == rows[b][2] and units[a] is not None and units[b] is not None
        and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98
    ]
    roots = brute_components(range(len(rows)), pairs)
    links, least = [0] * len(rows), {}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[roots[k]] = min(least.get(roots[k], r[0]), r[0])
    want = [(r[0], links[k], least[roots[k]], r[0] == least[roots[k]]) for k, r in enumerate(rows)]
    assert len(pairs) > 20
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert E.near_vectors(df.limit(0)).count() == 0
