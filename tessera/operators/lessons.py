"""Work memory on disk: saved answers, what they teach, and how that is shown on a graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import memory as M

# Outcomes that an answer may have, and how YAML spells what a quoted text can't hold.
OUTCOMES = ("useful", "dead_end", "corrected")
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", '"': '"', "\\": "\\", "L": "\u2028", "P": "\u2029"}
SOURCES = 10

DOCS = "path string, type string, date string, question string, outcome string, correction string, contributor string, source_nodes array<string>"


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return ESCAPES[m[1]]
        code = int(m[2] or m[3], 16)
        return m[0] if 0xD800 <= code <= 0xDFFF else chr(code)

    return re.sub(r'\\(?:([nrt0"\\LP])|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4}))', one, text)


def parse_doc(text: str) -> dict | None:
    """The front matter of a saved answer; null for other texts, so that lessons don't feed on themselves."""
    lines = text.splitlines()
    if not text.startswith("---") or lines[0].strip() != "---":
        return None
    out = {"type": "", "date": "", "question": "", "outcome": None, "correction": "", "contributor": "", "source_nodes": []}
    for line in lines[1:]:
        if line.strip() == "---":
            break
        key, colon, value = line.partition(":")
        value = value.strip()
        if key == "source_nodes":
            inside = re.search(r"\[(.*)\]", value, re.S)
            out[key] = [unescape(x) for x in re.findall(r'"((?:\\.|[^"\\])*)"', inside[1])] if inside else []
        elif colon and key in out and len(value) >= 2 and value[0] == value[-1] == '"':
            out[key] = unescape(value[1:-1])
    return out


def memory_docs(files: DataFrame) -> DataFrame:
    """SRC58: the saved answers among files (path, content), one row each; doc orders them by date, then by name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DOCS.split(", ")]
        for t in frames:
            rows = []
            for p, c in zip(t["path"], t["content"]):
                try:
                    doc = parse_doc(bytes(c).decode("utf-8")) if c is not None else None
                except UnicodeDecodeError:
                    continue
                if doc is not None:
                    rows.append({"path": p.rsplit("/", 1)[-1], **doc})
            yield pd.DataFrame(rows, columns=names)

    picked = files.where(F.endswith("path", F.lit(".md"))).select("path", F.col("content").cast("binary").alias("content"))
    return picked.mapInPandas(run, DOCS).withColumn("doc", F.concat("date", F.lit("\0"), "path"))


def quoted(text: Column) -> Column:
    """A text in double quotes, as YAML wants it."""
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for name, sign in ESCAPES.items():
        if name not in '"\\':
            text = F.replace(text, F.lit(sign), F.lit("\\" + name))
    for code in [*range(1, 32), 127]:
        if chr(code) not in "\n\r\t":
            text = F.replace(text, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return F.concat(F.lit('"'), text, F.lit('"'))


def saved(answers: DataFrame, contributor: str = "tessera") -> DataFrame:
    """BD17: (name, text): answers as Markdown with front matter.

    answers: type, at (timestamp), question, answer, outcome, correction, source_nodes; outcome and
    correction may be null.  An unknown outcome is an error.
    """
    c = F.col
    slug = F.trim(F.regexp_replace(F.substring(F.lower("question"), 1, 50), r"[^\p{IsAlphabetic}\p{N}_]", "_"), F.lit("_"))
    name = F.concat(F.lit("query_"), F.date_format("at", "yyyyMMdd_HHmmss"), F.lit("_"), slug, F.lit(".md"))
    wrong = c("outcome").isNotNull() & ~c("outcome").isin(*OUTCOMES)
    outcome = F.when(wrong, F.raise_error(F.concat(F.lit("unknown outcome "), "outcome"))).otherwise(c("outcome"))
    fix = F.nullif(c("correction"), F.lit(""))
    some = F.size(F.coalesce("source_nodes", F.array().cast("array<string>"))) > 0
    head = F.array(
        F.lit("---"), F.concat(F.lit("type: "), quoted(c("type"))), F.concat(F.lit('date: "'), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit('"')), F.concat(F.lit("question: "), quoted(c("question"))), F.lit(f'contributor: "{contributor}"'),
        F.concat(F.lit("outcome: "), quoted(outcome)), F.concat(F.lit("correction: "), quoted(fix)),
        F.when(some, F.concat(F.lit("source_nodes: ["), F.array_join(F.transform(F.slice("source_nodes", 1, SOURCES), quoted), ", "), F.lit("]"))),
        F.lit("---"), F.lit(""), F.concat(F.lit("# Q: "), "question"), F.lit(""), F.lit("## Answer"), F.lit(""), c("answer"),
    )
    signal = F.when(c("outcome").isNotNull() | fix.isNotNull(), F.concat_ws("\n", F.lit(""), F.lit("## Outcome"), F.lit(""), F.concat(F.lit("- Signal: "), "outcome"), F.concat(F.lit("- Correction: "), fix)))
    nodes = F.when(some, F.concat_ws("\n", F.lit(""), F.lit("## Source Nodes"), F.lit(""), F.transform("source_nodes", lambda x: F.concat(F.lit("- "), x))))
    return answers.select(name.alias("name"), F.concat_ws("\n", F.array_compact(head), signal, nodes).alias("text"))


def known_citations(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN11: docs whose source_nodes are those that are an id or a label of the graph."""
    known = nodes.select(F.col("id").alias("node")).union(nodes.select("label")).distinct()
    kept = docs.select("doc", F.posexplode(F.array_distinct("source_nodes")).alias("place", "node")).join(known, "node", "left_semi")
    lists = kept.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("source_nodes"))
    return docs.drop("source_nodes").join(lists, "doc", "left").withColumn("source_nodes", F.coalesce("source_nodes", F.array().cast("array<string>")))


def overlay(lessons: DataFrame, nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """BD19: (id, bucket, verdict, score, label, source_file, fingerprint): lessons on the nodes that they mean.

    A cited name is an id, or a label that one node only has.  Preferred comes before tentative
    before contested where several names mean a node.  hashes: source_file, hash.
    """
    c = F.col
    by_label = nodes.groupBy(c("label").alias("node")).agg(F.count("*").alias("n"), F.min("id").alias("lid")).where("n = 1").select("node", "lid")
    ids = nodes.select(c("id").alias("node"), c("id").alias("iid"))
    turn = F.array_position(F.array(F.lit("preferred"), F.lit("tentative"), F.lit("contested")), c("bucket"))
    meant = lessons.join(ids, "node", "left").join(by_label, "node", "left").withColumn("id", F.coalesce("iid", "lid")).where("id is not null")
    first = meant.groupBy("id").agg(F.min_by(F.struct("bucket", "verdict", "score"), F.struct(turn, -c("score"), c("node"))).alias("b"))
    out = first.select("id", "b.*").join(nodes.select("id", "label", "source_file"), "id").join(hashes.select("source_file", c("hash").alias("fingerprint")), "source_file", "left")
    return out.select("id", "bucket", "verdict", "score", "label", "source_file", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def stale(marked: DataFrame, hashes: DataFrame) -> DataFrame:
    """BD20: an overlay with a column stale: its file is gone, has changed, or was never hashed."""
    now = hashes.select("source_file", F.col("hash").alias("_now"))
    out = marked.join(now, "source_file", "left")
    changed = F.col("_now").isNull() | (F.col("fingerprint") == "") | (F.col("_now") != F.col("fingerprint"))
    return out.withColumn("stale", (F.coalesce("source_file", F.lit("")) != "") & changed).drop("_now")


def with_overlay(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """JN32: nodes with the lesson on them, if any."""
    return nodes.join(marked.select("id", "bucket", "verdict", F.col("score").alias("lesson_score"), "stale"), "id", "left")


def is_fresh(outputs: DataFrame, inputs: DataFrame) -> bool:
    """BD21: whether no input (modified) is newer than the output; an output that isn't there is not fresh."""
    made = outputs.agg(F.min("modified").alias("t")).first().t
    return made is not None and not inputs.where(F.col("modified") > F.lit(made)).limit(1).count()


def reflect(docs: DataFrame, nodes: DataFrame, now: Column, half_life: float = M.HALF_LIFE, least: int = M.CORROBORATION) -> DataFrame:
    """BD18: (node, bucket, verdict, score, pos, neg, last) of all saved answers as of now.

    Citations of nodes that aren't in the graph don't count.
    """
    d = known_citations(docs, nodes).withColumn("age", F.greatest((F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("date"))) / 86400, F.lit(0.0)))
    scored = M.scores(d, half_life)
    last = M.cited(d).where(M.sign(F.col("outcome")) != 0).groupBy("node").agg(F.max("date").alias("last"))
    return M.buckets(scored, least).join(scored.select("node", "pos", "neg"), "node").join(last, "node")


def write_overlay(marked: DataFrame, path: str) -> None:
    """SNK16: the overlay as JSON lines next to a graph."""
    marked.write.mode("overwrite").json(path)


def log_query(spark: SparkSession, path: str, record: dict) -> bool:
    """SNK18: appends a record; a failure is reported by false, never raised."""
    try:
        spark.createDataFrame([{k: v for k, v in record.items() if v is not None}]).coalesce(1).write.mode("append").json(path)
    except Exception:  # noqa: BLE001  a log must not stop a query
        return False
    return True


def community_names(files: DataFrame) -> DataFrame:
    """SRC59: (community, name) of JSON texts (content) that map numbers to names; other keys are left out."""
    rows = files.select(F.explode(F.from_json(F.col("content").cast("string"), "map<string,string>")).alias("k", "name"))
    return rows.select(F.col("k").try_cast("long").alias("community"), "name").where("community is not null and name is not null")
