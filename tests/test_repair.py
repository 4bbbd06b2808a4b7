"""Graph JSON, paths, seeds, matching of communities, journals and manifests on small fixtures."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import repair as R
from tessera.operators import sets as S
from tessera.sources import graph_json
from tessera.streaming import journal


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_match_communities(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{i}", rng.randrange(9), rng.choice([rng.randrange(12), 3])) for i in range(300)]
    old = spark.createDataFrame([(i, a) for i, a, _ in rows], "id string, community long")
    now = spark.createDataFrame([(i, b) for i, _, b in rows] + [("x", 40), ("y", 41), ("z", 41)], "id string, community long")
    counts = {}
    for _, a, b in rows:
        counts[a, b] = counts.get((a, b), 0) + 1
    want, used = {}, set()
    for (a, b), n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if b not in want and a not in used:
            want[b] = a
            used.add(a)
    sizes = {}
    for r in now.collect():
        sizes[r.community] = sizes.get(r.community, 0) + 1
    free = iter(i for i in range(100) if i not in used)
    for c in sorted((c for c in sizes if c not in want), key=lambda c: (-sizes[c], c)):
        want[c] = next(free)
    got = {r.new: r.id for r in S.match_communities(S.community_overlap(old, now), now).collect()}
    assert got == want
    empty = old.limit(0)
    assert {r.id for r in S.match_communities(S.community_overlap(empty, now), now).collect()} == set(range(len(sizes)))


def test_graph_json(spark, tmp_path):
    g = {
        "directed": False,
        "nodes": [
            {"id": "a", "name": "A", "path": "x/a.py", "file_type": "tool", "community": 3}, {"id": 7, "label": None, "source_file": None, "file_type": "pattern"},
            {"id": "b", "label": "B", "name": "other", "source": "s", "file_type": "code"}, {"label": "lost"}, "text", None,
        ],
        "edges": [{"from": "a", "to": 7, "type": "calls", "confidence_score": 0.4}, {"source": "b", "target": "a", "from": "z", "relation": "uses", "confidence": "EXTRACTED", "context": "arg"}, {"source": "b"}, []],
        "hyperedges": [{"id": "h", "members": ["a", "b"]}, {"id": "i", "nodes": ["b"], "members": ["a"]}, {"nodes": ["a"]}],
    }
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    (tmp_path / "links.json").write_text(json.dumps({"nodes": [], "links": [{"source": "q", "target": "r", "relation": "x"}], "edges": [{"source": "no", "target": "no"}]}))
    (tmp_path / "none.json").write_text("{}")
    (tmp_path / "broken.json").write_text('{"nodes": [')
    found = graph_json.rows(spark, str(tmp_path))
    h = graph_json.graph(found)
    assert {tuple(r) for r in h.nodes.select("id", "label", "file_type", "source_file", "community").collect()} == {("a", "A", "code", "x/a.py", 3), ("7", "", "concept", "", None), ("b", "B", "code", "s", None)}
    assert {tuple(r) for r in h.edges.select("src", "tgt", "relation", "confidence", "context").collect()} == {("a", "7", "calls", "INFERRED", None), ("b", "a", "uses", "EXTRACTED", "arg"), ("q", "r", "x", "EXTRACTED", None)}
    assert {(r.id, tuple(r.nodes)) for r in h.hyperedges.collect()} == {("h", ("a", "b")), ("i", ("b",))}
    causes = {(r.part, r.cause): r.n for r in graph_json.issues(found).collect()}
    assert causes == {("node", "no id"): 1, ("node", "no label"): 1, ("node", "no object"): 2, ("link", "no end"): 1, ("link", "no relation"): 1, ("link", "no object"): 1, ("hyperedge", "no id"): 1}
    with pytest.raises(ValueError):
        graph_json.rows(spark, str(tmp_path), cap=5)
    shas = {r.path.rsplit("/", 1)[1]: r.sha256 for r in graph_json.digests(spark, str(tmp_path), cap=20).collect()}
    assert shas["g.json"] is None and len(shas["none.json"]) == 64


def test_size_cap():
    cap = graph_json.size_cap
    assert (cap("12"), cap(" 3 mb"), cap("2GB"), cap("0"), cap("x"), cap(None), cap("-1")) == (12, 3 << 20, 2 << 30, *[graph_json.DEFAULT_CAP] * 4)


def test_paths(spark):
    c = F.col("v")
    assert one(spark, P.stem(c), v="a\\b.c/d.e.py") == "a/b.c/d.e" and one(spark, P.stem(c), v="a/.env") == "a/.env"
    assert one(spark, P.path_key(c), v=".\\A\\b.PY") == "a/b.py"
    assert one(spark, P.bare_name(c), v="Run()()") == "run()"
    assert one(spark, P.canonical_key(c), v="Api-Key_2") == "apikey2" and one(spark, P.canonical_key(c), v="--") is None
    assert one(spark, P.id_prefixes(c), v="src/My App/main.test.py") == ["main_test", "my_app_main_test", "src_my_app_main_test"] or set(one(spark, P.id_prefixes(c), v="src/My App/main.test.py")) == {"main_test", "my_app_main_test", "src_my_app_main_test"}
    assert one(spark, P.id_prefixes(c), v="") == []
    assert one(spark, P.defines_id(F.col("i"), c), i="app_main_run", v="x/app/main.py") and not one(spark, P.defines_id(F.col("i"), c), i="app_mainrun", v="x/app/main.py")
    assert [one(spark, P.is_remote(c), v=v) for v in ("https://a", "c:/x", "a b:/", "git+ssh://h", "x:y")] == [True, False, False, True, False]
    assert [one(spark, P.is_structural(c), v=v) for v in ("ast", "semantic", "?")] == [True, False, None]
    assert one(spark, P.path_match(c, F.lit("b/c.py")), v="a\\b\\c.py") and not one(spark, P.path_match(c, F.lit("b/c.py")), v="ab/c.py")
    assert one(spark, P.body_content(c), v="---\na: 1\n---\nbody\n---\n") == "body\n---\n" and one(spark, P.body_content(c), v="--- x") == "--- x"
    hashes = [one(spark, P.content_hash(F.lit(p), c), v=v) for p, v in (("a.md", "---\na: 1\n---\nt"), ("./A.md", "---\na: 2\n---\nt"), ("a.py", "t"))]
    assert hashes[0] == hashes[1] != hashes[2]
    assert one(spark, P.prompt_fingerprint(c), v="a \r\nb") == one(spark, P.prompt_fingerprint(c), v="a\nb")
    assert one(spark, P.parse_date(c).cast("long"), v="2024-03-01T02:00:00+02:00") == one(spark, P.parse_date(c).cast("long"), v="2024-03-01") == int(datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc).timestamp())
    assert one(spark, P.parse_date(c), v="2024-13-01") is None and one(spark, P.parse_date(c), v="") is None
    assert one(spark, P.days_old(F.lit(100), F.lit(100 + 86400 * 2 - 1)), v="") == 1
    assert [one(spark, P.elapsed(F.lit(x)), v="") for x in (5, 1500, 61_000, 7_260_000)] == ["5ms", "1.5s", "1m 01s", "2h 01m"]
    assert one(spark, P.is_media(F.lit("code"), c, F.lit(None), F.lit(None)), v="media") and not one(spark, P.is_media(F.lit("video"), c, F.lit(None), F.lit("enrichment")), v="")
    assert one(spark, P.enrichment_id(c, F.lit("s"), F.lit("p"), "salt"), v="r").startswith("r_") and one(spark, R.keeps_identity(c, F.lit(None), F.lit(None), F.lit(None)), v="code")
    assert one(spark, R.anchored_apart(c, F.lit("a"), F.lit("code"), F.lit("b")), v="document") and not one(spark, R.anchored_apart(c, F.lit("a"), F.lit("code"), F.lit("a")), v="document")


def test_seeds_prefer_the_file_node(spark):
    rows = [("1", "app.py", "src/app.py", "L1"), ("2", "run()", "src/app.py", "L5"), ("3", "Run()", "src/b.py", "L2"), ("4", "walk", "src/b.py", "L1"), ("5", "b.py", "src/b.py", "L1"), ("6", "only()", "src/c.py", "L9")]
    nodes = spark.createDataFrame(rows, "id string, label string, source_file string, source_location string")
    ask = ["1", "src/app.py", "src/b.py/", "run", "only", "wal", "ap", "nothing"]
    got = {r.query: r.id for r in R.resolve_seeds(nodes, spark.createDataFrame([(a,) for a in ask], "query string")).collect()}
    assert got == {"1": "1", "src/app.py": "1", "src/b.py/": "5", "only": "6", "wal": "4", "ap": "1"}


def test_repair(spark):
    nodes = spark.createDataFrame([("main_run", "Run", "src/main.py"), ("src_main_walk", "Walk", "src/main.py"), ("lib_main_go", "Go", "lib/main.py"), ("main_go", "Go", "lib/main.py")], "id string, label string, source_file string")
    assert {(r.old, r.new) for r in R.id_remap(nodes).collect()} == {("main_run", "src_main_run"), ("main_go", "lib_main_go")}
    assert R.has_legacy_ids(nodes) and not R.has_legacy_ids(nodes.where("id like '%walk' or id like 'lib%'"))
    assert {(r.alias, r.id) for r in R.legacy_aliases(nodes.where("id not like 'main%'")).collect()} == {("main_walk", "src_main_walk"), ("src_main", "src_main_walk"), ("main_go", "lib_main_go"), ("lib_main", "lib_main_go")}
    h = spark.createDataFrame([("a", 1), ("b", 2)], "id string, ord long")
    more = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5)], "id string, ord long")
    assert sorted(tuple(r) for r in R.attach_hyperedges(h, more).collect()) == [("a", 1), ("b", 2), ("c", 4)]
    apart = R.normalized(spark.createDataFrame([("r/a\\b.py", "Markdown"), ("q", "?")], "source_file string, file_type string"), "r/")
    assert sorted(tuple(r) for r in apart.collect()) == [("a/b.py", "document"), ("q", "concept")]


def test_journal_and_manifest(spark, tmp_path):
    path = f"{tmp_path}/journal"
    late = spark.createDataFrame([("b", 2), ("a", 1), ("b", 0)], "path string, ord long")
    journal.queue(late, path)
    journal.queue(spark.createDataFrame([("c", 9)], "path string, ord long"), path)
    assert [r.path for r in journal.drain(spark, path).orderBy("ord").collect()] == ["b", "a", "c"]
    assert journal.drain(spark, path).count() == 0
    folder = f"{tmp_path}/manifest"
    assert journal.load_manifest(spark, folder).count() == 0
    state = spark.createDataFrame([("p", 5, "h")], "path string, mtime long, hash string")
    journal.save_manifest(state, folder, 1)
    journal.save_manifest(state.limit(0), folder, 2)
    (tmp_path / "manifest" / "v=3").mkdir()
    assert journal.load_manifest(spark, folder).count() == 0
    assert S.manifest_delta(state, journal.load_manifest(spark, folder)).first().status == "deleted"
    ok = {r.p: r.x for r in spark.createDataFrame([(p,) for p in ("a/b.py", "out/b.py", "a/b.txt", "out", "vendor/x/c.PY")], "p string").select("p", journal.accepts(F.col("p"), ("py",), "out", ("vendor",)).alias("x")).collect()}
    assert ok == {"a/b.py": True, "out/b.py": False, "a/b.txt": False, "out": False, "vendor/x/c.PY": False}


def test_runs_are_merged(spark, tmp_path):
    schema, folder = "source_ord long, batch_ord long, x string", f"{tmp_path}/runs"
    for n, rows in enumerate([[(2, 0, "c"), (1, 1, "b")], [(1, 0, "a"), (3, 0, "d")]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/v={n}")
    runs = [spark.read.parquet(f"{folder}/v={n}") for n in (0, 1)]
    assert [r.x for r in journal.sorted_batches(runs).collect()] == list("abcd")
    journal.compact(spark, folder, 2)
    assert spark.read.parquet(f"{folder}/v=2").count() == 4 and journal.complete_versions(spark, folder) == [0, 1, 2]
    assert journal.duplicate_batches(runs[0].unionByName(runs[0])).count() == 2 and journal.duplicate_batches(runs[0].unionByName(runs[1])).count() == 0
