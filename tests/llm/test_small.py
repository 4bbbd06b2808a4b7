"""Operators on small tables against brute force, with nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import random

import pytest
import xxhash

from tessera.llm import bpe, contract, exact_dedup, simhash, url_filter
from tessera.llm.components import components
from tessera.llm.shared import Scratch


def brute_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 2001), (2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == brute_components(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


URLS = [
    (1, "http://a.Example.com/en/71?x"), (2, "http://example.com/en/6"), (3, None), (4, "no scheme"), (5, "http://x.net/de/8"),
    (6, "http://example.net/de/8#f"), (7, "http://badexample.net/de/8"), (8, "http://org/es/"), (9, "https://b.org:80/es/"), (10, ""),
    (None, "http://q.com/en/"), (1, "http://a.Example.com/en/71?x"), (11, "http://com/EN/"), (12, "x://y://z.com/en/1"), (13, "://com/en/" + "a" * 50000),
]


def test_url_filter(spark):
    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        rest = rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [r for r in contract.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        return host, path, best and best.host + best.path, best.verdict if best else "allow"

    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in URLS], "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, url_filter.judge(pages, url_filter.rules_table(spark, contract.URL_RULES)).collect()), key=str)
    assert got == sorted(((i, *judge(u)) for i, u in URLS), key=str)
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark, contract.URL_RULES)).count() == 0
    none = spark.createDataFrame([], "rule_host string, rule_path string, rule string, verdict string")
    assert {r.verdict for r in url_filter.judge(pages, none).collect()} == {"allow"}


DOCS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "a  b"), (6, "c"), (7, "c"), (8, "c"), (8, "c"), (None, "z"), (9, "z"), (10, "é"), (11, "x" * 100_000)]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, weak, keep):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, kept int")
    extra = {"hash128": lambda t: F.length(t).cast("string").cast("binary"), "digest": lambda t: F.lit("x")} if weak else {}
    rows = exact_dedup.groups(docs, keep=keep, **extra).collect()
    assert len(rows) == len(DOCS)
    low = lambda i: -1 if i is None else i
    by = {}
    for i, t in DOCS:
        by.setdefault(t or "", []).append(i)
    for r in rows:
        text = next(t or "" for i, t in DOCS if i == r.doc_id and hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(by[text]) and r.keep_id == (min if keep == "min" else max)(by[text], key=low)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in rows) == len(by)
    out = exact_dedup.dedup(docs, keep=keep)
    assert out.columns == docs.columns
    assert sorted((low(r.doc_id), r.text or "") for r in out.collect()) == sorted((low((min if keep == "min" else max)(ids, key=low)), t) for t, ids in by.items())
    assert exact_dedup.groups(docs.limit(0)).count() == 0 and exact_dedup.dedup(docs.limit(0)).count() == 0


def brute_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprint():
    for t in [None, "", " \n", "A b", "a B c", "x y z w x y z", "É\x1c é\x85x\xa0y " * 9, "q " * 70000]:
        assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t, 3)


@pytest.mark.parametrize("distance,groups", [(2, 2), (2, 3), (3, 2), (5, 3), (3, 4)])
def test_simhash_links(spark, distance, groups):
    rng = random.Random(distance * 10 + groups)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(12)} | {0}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, groups).collect()}
    want = {frozenset(p) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) % (1 << 64)).bit_count() <= distance}
    assert got == want


def test_simhash_groups(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, " "), (None, texts[0]), (0, texts[0])]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()), key=str)
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    roots = brute_components(range(len(rows)), pairs)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(least.get(roots[k], i), i)
    assert got == sorted(((i, f"{fps[k]:016x}", least[roots[k]]) for k, (i, _) in enumerate(rows)), key=str)
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_simhash_dedup(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(25)]
    rows, near = [(i, t) for i, t in enumerate(texts)], []
    for i, t in enumerate(texts):
        for k in range(3):
            w = t.split()
            w[rng.randrange(200)] = "x"
            near.append(len(rows))
            rows.append((100 + 3 * i + k, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " "), (None, texts[0]), (0, texts[0]), (503, "a b"), (504, "a c"), (505, "A  b")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, uid string")
    out = simhash.dedup(docs)
    assert out.columns == docs.columns
    got = out.collect()

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])

    def like(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) >= 0.8 * len(a | b)

    kept = [r.text for r in got]
    for i, t in rows:  # each row that goes is near one that stays
        assert any(like(t, k) for k in kept)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in got)
    assert ids[0] == -1 and ids.count(0) == 0 and set(range(1, 25)) | {500, 503, 504} <= set(ids) and 505 not in ids
    assert sum(i < 500 for i in ids) <= 25 + 8
    assert simhash.dedup(docs.limit(0)).count() == 0


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(contract.vocabulary())
    lib.no_truncation(), lib.no_padding()
    rng = random.Random(1)
    odd = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x500), rng.randrange(0x2000, 0x2100), rng.randrange(0x3000, 0xA700), rng.randrange(0x1F300, 0x1F700), 39]))
    texts = [None, "", "Hello World's <|endoftext|>x<|STARTOFTEXT|>", "ΑΣ ΣΑΣ ΟΔΟΣ.", "İ ǅ ẞ", "a\x1cb\x85c　d", "e\u0301", "x" * 5000, "ab" * 700, "hello" * 400]
    texts += ["".join(odd() for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encoded(docs, contract.vocabulary(), outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert list(got[i].ids) == ids and got[i].decoded == decoded and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encoded(docs.limit(0), contract.vocabulary()).count() == 0
