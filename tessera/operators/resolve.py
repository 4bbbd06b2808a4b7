"""Resolution of names across a corpus: each pass is a join that binds only what is unambiguous."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.analysis import language_family

Resolver = Callable[[DataFrame, DataFrame], DataFrame]


def is_test_path(path: Column) -> Column:
    """FLT10: a file of tests, by a folder or by its name."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    folder = p.rlike(r"(?i)(^|/)(tests|test|spec|specs|__tests__)(/|$)")
    name = F.regexp_extract(p, "([^/]*)/*$", 1)
    by_name = name.rlike(r"(?i)^test_|_test\.|\.test\.|\.spec\.|_spec\.|\.tests\.ps1$") | name.rlike(r"(Test\.java|Tests\.java|Tests\.cs)$")
    return (path != "") & (folder | by_name)


def common_dirs(a: Column, b: Column) -> Column:
    """How many folders two paths have in common from the start."""
    dirs = lambda c: F.slice(F.split(c, "/"), 1, F.size(F.split(c, "/")) - 1)
    same = F.zip_with(dirs(a), dirs(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))["n"]


def bind_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """JN13 to JN15, JN21: (caller, name, target): calls bound to a definition of that name and language family.

    calls: caller, file, name.  definitions: id, file, name.  One candidate is taken.  Of several,
    callers outside tests leave tests out, callers in tests first take their own file; then the
    same file, the same folder and the longest common path win, if one candidate alone has it.
    """
    d = definitions.select(F.col("id").alias("target"), F.col("file").alias("dfile"), F.col("name"))
    pairs = calls.join(d, "name").where(F.coalesce(language_family(F.col("file")) == language_family(F.col("dfile")), F.lit(True)))
    pairs = pairs.where(is_test_path(F.col("file")) | ~is_test_path(F.col("dfile")))
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    near = F.when(F.col("file") == F.col("dfile"), 1_000_001).when(folder("file") == folder("dfile"), 1_000_000).otherwise(common_dirs(F.col("file"), F.col("dfile")))
    ranked = pairs.withColumn("near", near)
    # The two best candidates of each call are enough to see whether the best is alone.
    best = ranked.groupBy("caller", "file", "name").agg(F.count("*").alias("n"), F.max("near").alias("near"))
    top = ranked.join(best.select("caller", "file", "name", F.col("n"), F.col("near").alias("top")), ["caller", "file", "name"]).where("near = top")
    lone = top.groupBy("caller", "file", "name").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.max("top").alias("top"), F.min("target").alias("target"))
    return lone.where("n = 1 or (k = 1 and top > 0)").select("caller", "name", "target")


def bind_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """JN20: (file, spec, target): imports by exact path, else by a base name that one file only has; else null."""
    exact = files.select(F.col("path").alias("exact"))
    base = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    lone = files.groupBy(base("path").alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("only")).where("n = 1").select("base", "only")
    out = imports.join(exact, imports.spec == exact.exact, "left").withColumn("base", base("spec")).join(lone, "base", "left")
    return out.select("file", "spec", F.coalesce("exact", "only").alias("target"))


def probe_modules(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js")) -> DataFrame:
    """JN22, JN23: (file, spec, target): relative imports by the first of the spellings that is a file."""
    parts = F.split(F.concat(F.regexp_replace("file", "[^/]*$", ""), F.col("spec")), "/")
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    base = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    tries = imports.where(F.startswith("spec", F.lit("."))).withColumn("base", base).select("file", "spec", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in extensions])).alias("place", "path"))
    found = tries.join(files.select("path"), "path", "left_semi")
    best = found.groupBy("file", "spec").agg(F.min_by("path", "place").alias("target"))
    return imports.select("file", "spec").join(best, ["file", "spec"], "left")


def run_resolvers(nodes: DataFrame, edges: DataFrame, resolvers: list[tuple[str, Resolver]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """UDF3, UDF4: the edges after all passes, and the (name, error) of passes that failed to plan; the others go on."""
    failed = []
    for name, resolver in resolvers:
        try:
            new = resolver(nodes, edges)
            new.schema  # noqa: B018  fails here if the pass can't be planned
            edges = new
        except Exception as e:  # noqa: BLE001  a pass is foreign code
            failed.append((name, f"{type(e).__name__}: {e}"))
    return edges, failed
