"""Operators on tiny fixtures."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import sensitive
from tessera.functions import text as X
from tessera.model import PropertyGraph, canonical_file_type, numeric
from tessera.operators import entities, export, measures, resolve, search, sets, traverse
from tessera.plans.engine import Engine
from tessera.sources import documents, files


def tiny(spark, nodes, edges):
    n = [(i, label, "code", f"{i}.py", c, k) for k, (i, label, c) in enumerate(nodes)]
    e = [(*x, "EXTRACTED", f"{x[0]}.py", None) for x in edges]
    return PropertyGraph(spark.createDataFrame(n, "id string, label string, file_type string, source_file string, community long, node_ord long"), spark.createDataFrame(e, "src string, tgt string, relation string, confidence string, source_file string, context string"))


def test_text():
    assert X.normalize_id("Foo-Bar/Ünï ß_") == "foo_bar_ünï_ss"
    assert X.normalized_label("  Hello__World! ") == "hello world"
    assert X.search_tokens("Café_x y") == ["cafe_x", "y"]
    assert X.query_terms("What is the Foo of it") == ["foo"] and X.query_terms("what is") == ["what"]
    assert X.query_terms("图数据库") == ["图数", "数据", "据库", "图数据库"]
    assert X.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6) and X.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert X.edit_distance("ca", "ac") == 1 and X.edit_distance("kitten", "sitting") == 3
    assert X.is_variant_pair("item1", "item2") and not X.is_variant_pair("item1", "item1") and X.numbers_differ("v1", "v2") and not X.numbers_differ("v01", "v1")
    for t in ["", "abc", "é" * 9, "a\n# b\n\nc\nd" * 9]:
        for n in (1, 3, 10):
            cuts, data = X.slice_boundaries(t, n), t.encode()
            assert b"".join(data[a:b] for a, b in cuts) == data
            [data[a:b].decode() for a, b in cuts]


def test_sensitive():
    for line in ["password = x", "export API_TOKEN=abc", "Bearer abcdefghijklmnop", "basic dXNlcjpwYXNz", "https://u:p@h/x", "AKIA" + "A" * 16, "ghp_12345678", "eyJa.b.c", "-----BEGIN RSA PRIVATE KEY-----"]:
        assert sensitive.line_is_sensitive(line), line
    for line in ["", "page_token: 5", "hello world", "password =", "https://h/x@y", "token"]:
        assert not sensitive.line_is_sensitive(line), line


def test_columns(spark):
    df = spark.createDataFrame([("1.5", "Text"), ("-2", "weird"), ("NaN", "code"), ("x", None)], "w string, t string")
    assert [tuple(r) for r in df.select(numeric(F.col("w")), canonical_file_type(F.col("t"))).collect()] == [(1.5, "document"), (1.0, "concept"), (1.0, "code"), (1.0, "concept")]


def test_hub_gate(spark):
    leaves = [(f"l{i}", f"leaf {i}", 0) for i in range(60)]
    g = tiny(spark, [("a", "a", 0), ("hub", "hub", 0), *leaves], [("a", "hub", "calls"), *[("hub", x[0], "calls") for x in leaves]])
    seed = lambda i: g.nodes.where(F.col("id") == i).select("id")
    assert {r.id for r in traverse.bfs(g, seed("a"), 3).collect()} == {"a", "hub"}
    assert traverse.bfs(g, seed("hub"), 1).count() == 62


def test_paths_and_cycles(spark):
    g = tiny(spark, [(c, c, None) for c in "abcdez"], [("a", "b", "calls"), ("b", "c", "calls"), ("a", "d", "uses"), ("d", "c", "calls"), ("c", "e", "calls"), ("a", "gone", "calls")])
    assert [r.id for r in traverse.shortest_path(g, "a", "e").orderBy("step").collect()] == ["a", "b", "c", "e"]
    assert traverse.shortest_path(g, "a", "z").count() == 0
    assert {(r.id, r.hop, r.via) for r in traverse.affected(g, "c", 2).collect()} == {("b", 1, "c"), ("d", 1, "c"), ("a", 2, "b")}
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "z"), ("z", "x"), ("q", "q")], "a string, b string")
    assert {(r.length, r.cycle) for r in traverse.cycles(pairs).collect()} == {(1, "q"), (2, "x > y"), (3, "x > y > z")}
    assert [r.id for r in traverse.dfs(g, "a", 2).orderBy("place").collect()] == ["a", "b", "c", "d"]
    assert {r.end for r in sets.dangling(g).collect()} == {"tgt"}
    empty = tiny(spark, [], [])
    assert measures.degrees(empty).count() == 0 and search.find_nodes(search.searchable(empty), "x").count() == 0


def test_entities(spark):
    rows = [("n1", "Graph Database Engine", "concept", "a.md"), ("n2", "Graph Databse Engine", "concept", "a.md"), ("n3", "release 12 candidate", "concept", "a.md"), ("n4", "release 13 candidate", "concept", "a.md"), ("n5", "graph database engine", "concept", "b.md")]
    n = spark.createDataFrame([(*r, None, k) for k, r in enumerate(rows)], "id string, label string, file_type string, source_file string, community long, node_ord long")
    n = entities.labels(n)
    assert [tuple(r) for r in entities.fuzzy_pairs(n).collect()] == [("n1", "n2")]
    assert [tuple(r) for r in entities.exact_pairs(n).collect()] == [("n1", "n5")]
    chain = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in entities.components(chain).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    assert entities.components(chain.limit(0)).count() == 0


def test_resolve(spark):
    defs = spark.createDataFrame([("d1", "src/a/x.py", "save"), ("d2", "src/b/y.py", "save"), ("d3", "tests/t.py", "save"), ("d4", "lib/z.rs", "load")], "id string, file string, name string")
    calls = spark.createDataFrame([("c1", "src/a/main.py", "save"), ("c2", "other/main.py", "save"), ("c3", "lib/q.rs", "load"), ("c4", "app.js", "load")], "caller string, file string, name string")
    assert {tuple(r) for r in resolve.bind_calls(calls, defs).collect()} == {("c1", "save", "d1"), ("c3", "load", "d4")}
    known = spark.createDataFrame([("web/lib/util.ts",), ("web/lib/index.js",), ("p/one.proto",)], "path string")
    imports = spark.createDataFrame([("web/app/main.ts", "../lib/util"), ("web/app/main.ts", "../lib"), ("web/app/main.ts", "./gone")], "file string, spec string")
    assert {(r.spec, r.target) for r in resolve.probe_modules(imports, known).collect()} == {("../lib/util", "web/lib/util.ts"), ("../lib", "web/lib/index.js"), ("./gone", None)}
    idl = spark.createDataFrame([("p/two.proto", "one.proto"), ("p/two.proto", "x.proto")], "file string, spec string")
    assert {(r.spec, r.target) for r in resolve.bind_paths(idl, known).collect()} == {("one.proto", "p/one.proto"), ("x.proto", None)}
    _, failed = resolve.run_resolvers(defs, calls, [("bad", lambda n, e: e.select("nothing")), ("good", lambda n, e: e)])
    assert [f[0] for f in failed] == ["bad"]


def test_parsers():
    facts = lambda p, c: {(r[0], r[2] or r[4], r[3]) for r in documents.extract(p, c.encode())}
    assert ("node", "<redacted>", "value") in facts("a.json", '{"password": "x", /* c */ "b": [1,],}')
    assert ("edge", "q.sql#a", "reads_from") in facts("q.sql", "create view v as select * from a -- from b")
    assert ("edge", "g.dot#a", "flows_to") in facts("g.dot", "digraph { b -> a }")
    assert ("node", "f()", "method") in facts("p.py", "class A:\n  def f(self): pass\n")
    assert any(r[0] == "diagnostic" for r in documents.extract("b.json", b"{")) and any(r[0] == "diagnostic" for r in documents.extract("b.md", b"\xff"))
    tree = [r for r in documents.extract("t.html", b"<h1>A</h1><h2>B</h2><h1>C</h1><a href='x'>") if r[3] == "document_heading"]
    assert [(r[2], r[4]) for r in tree] == [("A", "t.html"), ("B", "t.html#$heading[1]"), ("C", "t.html")]
    for name in documents.PARSERS:
        documents.extract(f"f.{name}", b"")
        documents.extract(f"f.{name}", "é {[(<\n= : \"'".encode() * 20)


def test_engine(spark, tmp_path):
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("import os\nclass A:\n    def f(self): g()\ndef g(): pass\n")
    (src / "doc.md").write_text("# Title\n[x](a.py)\n")
    (src / "node_modules" / "z.js").write_text("function z(){}")
    (src / "skip.log.md").write_text("# no")
    (src / "server.key").write_text("x")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("inside.txt", "x")
    (src / "z.zip").write_bytes(buffer.getvalue())
    found = {r.relative: r.status for r in files.discover(spark, str(src), ["*.log.md"]).collect()}
    assert found == {"a.py": "covered", "doc.md": "covered", "node_modules/z.js": "excluded_noise", "skip.log.md": "excluded_ignored", "server.key": "excluded_sensitive", "z.zip": "unsupported"}
    e = Engine(spark, str(tmp_path / "graph"))
    assert e.build(str(src), ["*.log.md"])
    labels = {r.label for r in e.graph().nodes.collect()}
    assert {"a.py", "A", "f()", "g()", "Title"} <= labels and "z()" not in labels
    assert ("a.py#A.f", "a.py#g") in {(r.src, r.tgt) for r in e.graph().edges.where("relation = 'calls'").collect()}
    assert e.query("the title").count() > 0 and e.query("g").count() == 0 and "Graph report" in e.export("report") and e.export("cypher").count() > 5
    assert not export.write_graph(tiny(spark, [("a", "a", None)], [("a", "a", "calls")]), e.path)
    assert e.cluster().nodes.where("community is null").count() == 0
    members = {r.label for r in files.binary_facts(documents.read_files(spark, str(src)).where("path like '%.zip'")).collect()}
    assert "inside.txt" in members
    f = documents.Facts("package.json")
    files.package_manifest(f, json.dumps({"name": "p", "dependencies": {"q": "1"}}))
    assert ("edge", "package:p", "", "depends_on", "package:q", 1) in f.rows


def test_stream(spark, tmp_path):
    from tessera.streaming import merge

    a = spark.createDataFrame([("1", "old", "f", "ast", 1), ("2", "two", "g", "ast", 1)], "id string, label string, source_file string, tier string, ord long")
    b = spark.createDataFrame([("1", "new", "f", "ast", 2), ("1", "newer", "f", "ast", 3)], a.schema)
    for k, d in enumerate((a, b)):
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        merge.merge_stream(spark, f"{tmp_path}/in", a.schema, f"{tmp_path}/state", f"{tmp_path}/check")
    assert {(r.id, r.label) for r in merge.latest(spark, f"{tmp_path}/state").collect()} == {("1", "newer"), ("2", "two")}


def test_sketches(spark):
    from tessera.operators import sketch

    a, b = "the quick brown fox jumps over the lazy dog again and again", "the quick brown fox jumps over the lazy dog again and agaim"
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    x, y = sketch.sketch(a, 512), sketch.sketch(b, 512)
    assert abs(sum(p == q for p, q in zip(x, y)) / 512 - true) < 0.06
    assert len(sketch.sketch("")) == len(sketch.sketch("é")) == 32
    docs = spark.createDataFrame([("1", a), ("2", b), ("3", "something else entirely, without a word of it"), ("4", None)], "id string, text string")
    assert {(r.a, r.b) for r in sketch.sketch_pairs(docs, 0.6, 64).collect()} == {("1", "2")}
    copies = spark.createDataFrame([(str(n), a) for n in range(40)] + [("x", b)], "id string, text string")
    got = {(r.a, r.b): r.similarity for r in sketch.sketch_pairs(copies, 0.6, 64).collect()}
    assert set(got) == {("0", str(n)) for n in range(1, 40)} | {("0", "x")} and all(got["0", str(n)] == 1 for n in range(1, 40))
    bands, rows = sketch.lsh_bands(0.7, 32)
    assert bands * rows <= 32


def test_diagrams_and_named_files():
    edges = lambda p, c: {(r[1].split("#")[-1], r[4].split("#")[-1], r[3]) for r in documents.extract(p, c.encode()) if r[0] == "edge" and r[3] != "contains"}
    assert edges("a.mmd", "graph TD\nA[Start] --> B{Ask}\nB -->|yes| C") == {("A", "B", "flows_to"), ("B", "C", "flows_to")}
    assert edges("a.puml", "class A\nA <|-- B\nB --> C") == {("B", "A", "inherits"), ("B", "C", "flows_to")}
    assert edges("a.d2", "x -> y: hi\nz: Zed") == {("x", "y", "flows_to")}
    assert edges("a.dbml", "Table a {\n id int\n b_id int [ref: > b.id]\n}") == {("a", "b", "references")}
    assert edges("w.dsl", 'u = person "User"\ns = softwareSystem "S"\nu -> s "uses"') == {("u", "s", "uses")}
    assert edges("x/package.json", '{"name": "p", "dependencies": {"q": "1"}}') == {("package:p", "package:q", "depends_on")}
    assert ("node", "GET /a") in {(r[0], r[2]) for r in documents.extract("openapi.json", b'{"openapi": "3", "paths": {"/a": {"get": {}}}}')}


def test_semantic(spark):
    from tessera.operators import semantic as S

    assert S.salvage_json('Here: ```json\n{"a": 1}\n``` done') == {"a": 1} and S.salvage_json("none") == {}
    assert S.salvage_labels('{"1": "One", "2": "Two", "3": "Th', [1, 2, 3]) == {1: "One", 2: "Two"}
    assert S.fragment_problems({"nodes": [{"id": "a"}, {}], "edges": [{"source": "a", "target": "z"}]}) == ["node 1 has no id", "edge 0 has an unknown end"]
    assert S.adaptive([1, 2, 3, 4], lambda u: {"n": len(u)} if len(u) < 3 else None) == [{"n": 2}, {"n": 2}]
    n = spark.createDataFrame([("a", "save_all()", "code", "a.py"), ("b", "gone_fn()", "code", "a.py"), ("r", "because", "rationale", "a.py")], "id string, label string, file_type string, source_file string")
    e = spark.createDataFrame([("r", "a", "rationale_for"), ("a", "b", "calls")], "src string, tgt string, relation string")
    kept, left = S.fold_rationales(n, e)
    assert {(r.id, r.rationale) for r in kept.collect()} == {("a", "because"), ("b", None)} and left.count() == 1
    src = spark.createDataFrame([("a.py", "def save_all(): pass")], "source_file string, text string")
    assert {(r.id, r.verified) for r in S.bind_evidence(n, src).collect()} == {("a", True), ("b", False), ("r", None)}
    nodes, edges = S.summaries(n, e, spark.createDataFrame([("s", "a", "sum")], "id string, media string, label string"))
    assert nodes.count() == 4 and edges.where("relation = 'has_enrichment'").count() == 1
    with pytest.raises(ValueError):
        S.summaries(n, e, spark.createDataFrame([("s", "zz", "sum")], "id string, media string, label string"))
