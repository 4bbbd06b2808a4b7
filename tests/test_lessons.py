"""Saved answers, URL policy, contexts of questions and walks on small fixtures."""

import datetime
import ipaddress

import pytest
from pyspark.sql import functions as F

from tessera.functions import safety as Y
from tessera.model import PropertyGraph
from tessera.operators import ask as K
from tessera.operators import lessons as N

ANSWER = "type string, at timestamp, question string, answer string, outcome string, correction string, source_nodes array<string>"


def test_saved_answers_are_read_back(spark):
    odd = 'a "b"\\ \n\r\t\x01\x7f   end'
    rows = [("query", datetime.datetime(2024, 5, 6, 7, 8, 9), odd, "---\noutcome: \"useful\"", "dead_end", odd, [odd] + [f"n{i}" for i in range(12)]), ("query", datetime.datetime(2024, 5, 6, 7, 8, 10), "  ", "", None, None, None)]
    got = N.saved(spark.createDataFrame(rows, ANSWER))
    files = got.select(F.col("name").alias("path"), F.col("text").alias("content"))
    more = spark.createDataFrame([("x/LESSONS.md", "# Lessons"), ("x/b.txt", "---\n---"), ("y.md", None), ("z.md", "---\nquestion: unquoted\ndate: \"d\"")], "path string, content string")
    docs = {r.path: r for r in N.memory_docs(files.unionByName(more)).collect()}
    assert set(docs) == {"query_20240506_070809_a__b.md".replace("a__b", [r.name for r in got.collect() if "070809" in r.name][0][22:-3]), "query_20240506_070810_.md", "z.md"}
    first = next(r for r in docs.values() if r.outcome)
    assert (first.question, first.correction, first.source_nodes[0], len(first.source_nodes)) == (odd, odd, odd, 10)
    assert docs["z.md"].question == "" and docs["z.md"].date == "d"
    with pytest.raises(Exception, match="unknown outcome"):
        N.saved(spark.createDataFrame([("q", None, "", "", "nice", None, None)], ANSWER)).collect()


def test_reflect_and_freshness(spark):
    docs = spark.createDataFrame([("a", "2024-01-01T00:00:00Z", "q", "useful", ["n", "lost"]), ("b", "2024-01-31T00:00:00Z", "q", "useful", ["N", "n"]), ("c", "", "q", None, ["n"])], "doc string, date string, question string, outcome string, source_nodes array<string>")
    nodes = spark.createDataFrame([("n", "N", "f.py")], "id string, label string, source_file string")
    got = {r.node: (r.bucket, r.score, r.pos, r.last) for r in N.reflect(docs, nodes, F.to_timestamp(F.lit("2024-01-31T00:00:00Z"))).collect()}
    assert got == {"n": ("preferred", 1.5, 2, "2024-01-31T00:00:00Z"), "N": ("tentative", 1.0, 1, "2024-01-31T00:00:00Z")}
    times = lambda *t: spark.createDataFrame([(x,) for x in t], "modified long")
    assert N.is_fresh(times(5), times(3, 5)) and not N.is_fresh(times(5), times(6)) and not N.is_fresh(times(), times(1)) and N.is_fresh(times(1), times())


def test_ambiguous_labels_get_no_lesson(spark):
    nodes = spark.createDataFrame([("a", "X", "f"), ("b", "X", "f"), ("c", "Y", "")], "id string, label string, source_file string")
    lessons = spark.createDataFrame([("X", "preferred", None, 1.0), ("Y", "contested", "even", 0.0), ("c", "tentative", None, 0.5)], "node string, bucket string, verdict string, score double")
    hashes = spark.createDataFrame([("f", "1")], "source_file string, hash string")
    got = N.stale(N.overlay(lessons, nodes, hashes), hashes).collect()
    assert [(r.id, r.bucket, r.stale) for r in got] == [("c", "tentative", False)]


def test_log_and_names(spark, tmp_path):
    path = str(tmp_path / "log")
    assert N.log_query(spark, path, {"question": "q", "n": 3, "x": None}) and N.log_query(spark, path, {"question": "r", "n": 4})
    assert spark.read.json(path).count() == 2
    assert not N.log_query(spark, "nosuch://x/y", {"question": "q"})
    files = spark.createDataFrame([('{"1": "One", "x": "no", "2": null}',), ("no json",), (None,)], "content string")
    assert [(r.community, r.name) for r in N.community_names(files).collect()] == [(1, "One")]


def test_urls_and_masks():
    assert Y.url_problem("https://a.example/x") is None and Y.url_problem(None) == "scheme" and Y.url_problem("http://[::1") == "invalid"
    assert Y.url_problem("https://a.example/", lambda h: ["8.8.8.8", "10.0.0.1"]) == "address" and Y.url_problem("https://a.example/", lambda h: []) == "unresolved"
    assert all(Y.address_is_blocked(ipaddress.ip_address(a)) for a in ("0.1.2.3", "198.19.0.1", "64:ff9b::a00:1", "fe80::1", "ff02::1", "255.255.255.255"))
    text, lang = Y.mask_markup('<p>é</p>\n<script setup lang="ts">let a</script>')
    assert lang == "ts" and text.split("\n")[1].strip() == "let a" and len(text.split("\n")[0]) == len("<p>é</p>".encode())


def test_contexts():
    assert K.contexts("who calls the module") == (["call", "import"], "heuristic")
    assert K.contexts("who calls", ["Params", " ", "param"]) == (["parameter_type"], "explicit")
    assert K.contexts("plain") == ([], None)


def test_walks(spark):
    n = spark.createDataFrame([(i, i, "code", f"{i}.py", None, k) for k, i in enumerate(("alpha", "beta", "gamma", "delta"))], "id string, label string, file_type string, source_file string, community long, node_ord long")
    rows = [("alpha", "beta", "calls", "EXTRACTED", "f", None), ("alpha", "gamma", "uses", "EXTRACTED", "f", None), ("beta", "delta", "calls", "EXTRACTED", "f", None)]
    g = PropertyGraph(n, spark.createDataFrame(rows, "src string, tgt string, relation string, confidence string, source_file string, context string"))
    reached = lambda df: {r.src for r in df.where("kind = 'node'").collect()}
    assert reached(K.ask(g, "alpha called", depth=2)) == {"alpha", "beta", "delta"}
    assert reached(K.ask_filtered(g, "alpha", ["uses"])) == {"alpha", "gamma"}
    assert [r.id for r in K.ask_deep(g, "alpha").orderBy("place").collect()] == ["alpha", "beta", "delta", "gamma"]
    path = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "step long, id string")
    assert K.path_within(path, 2).count() == 3 and K.path_within(path, 1).count() == 0
    assert K.edges_between(g.edges, "beta", "alpha").count() == 1
    assert set(K.analyze(g)) == {"gods", "surprises", "questions"}
