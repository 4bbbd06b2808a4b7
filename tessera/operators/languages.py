"""Binding of types and calls across files by the rules of each language.

Everything is an equi-join on (language, key); a name binds only where one candidate stands in the
first tier that has any.  Languages never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import cut

# Where each language looks for a type, in turn; what is declared nowhere in between stays unbound.
TIERS = {
    "java": ("file", "import", "namespace", "wildcard"),  # JN24
    "csharp": ("file", "namespace", "wildcard"),  # JN25
    "php": ("file", "import", "namespace"),  # JN26
    "ruby": ("lexical", "corpus"),  # JN27
    "swift": ("file", "corpus"),  # JN28
    "pascal": ("file", "wildcard"),  # JN29
    "native": ("file", "corpus"),  # JN30
    "dart": ("file", "file_import"),
}
CASELESS = ("php", "pascal")
#: Bases are followed so far up.
LEVELS = 8


def _key(name: Column, language: Column) -> Column:
    """A name as its language compares it."""
    return F.when(language.isin(*CASELESS), F.lower(name)).otherwise(name)


def type_id(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit("#"), name)


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/|\.[^./]*$", "")


def _dotted(space: Column, name: Column) -> Column:
    return F.when(space == "", name).otherwise(F.concat(space, F.lit("."), name))


def bind_types(uses: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, namespace, name, target): the type that each name means in its file and namespace.

    uses: source_file, language, namespace, name; a name may be qualified by dots.  Types are counted
    by each tier's own key first, so that a name that many files declare is one row of a join.
    """
    c = F.col
    types = rows.where("kind = 'type'").select("language", "source_file", _key(c("namespace"), c("language")).alias("space"), _key(_last(c("name")), c("language")).alias("key"), type_id(c("source_file"), c("name")).alias("target")).distinct()
    types = types.withColumns({"whole": _dotted(c("space"), c("key")), "stem": _stem(c("source_file"))})
    lone = lambda *by: types.groupBy("language", *by).agg(F.count("*").alias("n"), F.min("target").alias("target"))
    u = uses.select("source_file", "language", "namespace", "name").distinct()
    lower = _key(c("name"), c("language"))
    u = u.withColumns({"key": _last(lower), "pre": F.regexp_replace(lower, r"\.?[^.]*$", ""), "space": _key(c("namespace"), c("language"))})
    imports = rows.where("kind = 'import'").select("source_file", "language", _key(c("name"), c("language")).alias("whole")).distinct()
    plain = u.where("pre = ''")
    outer = F.split(c("space"), r"\.")
    # All namespaces around a use, the innermost first, the corpus' own last.
    around = F.concat(F.transform(F.sequence(F.size(outer), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(outer, F.lit(1), k), ".")), F.array(F.lit("")))
    spaces = imports.withColumn("space", F.regexp_replace("whole", r"\.\*$", "")).select("source_file", "language", "space")
    linked = rows.where("kind = 'import_file'").select("source_file", _stem(c("name")).alias("stem")).distinct()
    by_whole = lone("whole")
    whole = ["language", "whole"]
    tiers = {
        "file": plain.join(lone("source_file", "key"), ["language", "source_file", "key"]),
        "import": plain.join(imports.withColumn("key", _last(c("whole"))), ["source_file", "language", "key"]).join(by_whole, whole),
        "namespace": u.withColumn("whole", F.explode(F.array_distinct(F.array(_dotted(c("space"), lower), F.when(c("pre") != "", lower).otherwise(_dotted(c("space"), lower)))))).join(by_whole, whole),
        "wildcard": plain.drop("space").join(spaces, ["source_file", "language"]).withColumn("whole", _dotted(c("space"), c("key"))).join(by_whole, whole),
        "lexical": u.select("*", F.posexplode(F.array_distinct(around)).alias("sub", "at")).withColumn("whole", _dotted(c("at"), lower)).join(by_whole, whole),
        "corpus": plain.join(lone("key"), ["language", "key"]),
        "file_import": plain.join(linked, "source_file").join(lone("stem", "key"), ["language", "stem", "key"]),
    }
    found = None
    for name, hits in tiers.items():
        turn = F.lit(None).cast("int")
        for language, names in TIERS.items():
            if name in names:
                turn = F.when(c("language") == language, names.index(name)).otherwise(turn)
        sub = c("sub") if name == "lexical" else F.lit(0)
        part = hits.withColumn("tier", turn).where("tier is not null").select("source_file", "namespace", "name", F.struct("tier", sub.alias("sub")).alias("tier"), "n", "target")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("source_file", "namespace", "name", "tier").agg((F.max("n") + F.count_distinct("target") - 1).alias("n"), F.min("target").alias("target"))
    first = best.groupBy("source_file", "namespace", "name").agg(F.min_by(F.struct("n", "target"), "tier").alias("b"))
    return first.where("b.n = 1").select(c("source_file").alias("file"), "namespace", "name", c("b.target").alias("target"))


def bases(rows: DataFrame) -> DataFrame:
    """(src, tgt, relation): what types inherit from, implement or mix in."""
    b = rows.where("kind = 'base'")
    bound = bind_types(b, rows).withColumnRenamed("file", "source_file")
    out = b.join(bound, ["source_file", "namespace", "name"]).select(type_id(F.col("source_file"), F.col("owner")).alias("src"), F.col("target").alias("tgt"), "relation")
    return out.where("src <> tgt").distinct()


def ancestors(links: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(type, above, dist): all types above a type, the shortest way; cycles end."""
    step = cut(links.select(F.col("src").alias("type"), F.col("tgt").alias("above")).distinct())
    out = step.withColumn("dist", F.lit(1))
    edge = out
    for level in range(2, levels + 1):
        edge = edge.select("type", F.col("above").alias("mid")).join(step.toDF("mid", "above"), "mid").select("type", "above").distinct()
        edge = cut(edge.join(out.select("type", "above"), ["type", "above"], "left_anti").where("type <> above").withColumn("dist", F.lit(level)))
        if not edge.limit(1).count():
            break
        out = out.unionByName(edge)
    return out


def typed_calls(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(src, tgt, relation) of calls: the nearest method of that name on the receiver's type or above it.

    A call binds if the receiver's type is known and one method stands nearest.  A call of the base
    looks above the type only.
    """
    c = F.col
    up = ancestors(links)
    calls = rows.where("kind = 'call' and owner <> '' and receiver <> ''").withColumn("uname", F.when(c("receiver") == "<super>", c("owner")).otherwise(c("receiver")))
    bound = bind_types(calls.select("source_file", "language", "namespace", c("uname").alias("name")), rows).select(c("file").alias("source_file"), "namespace", c("name").alias("uname"), c("target").alias("type"))
    extended = rows.where("kind = 'extended'")
    own = bind_types(extended.select("source_file", "language", "namespace", c("owner").alias("name")), rows).select(c("file").alias("source_file"), "namespace", c("name").alias("owner"), c("target").alias("of"))
    name = lambda: _key(c("name"), c("language")).alias("key")
    method = F.concat(type_id(c("source_file"), c("owner")), F.lit("."), "name").alias("method")
    methods = rows.where("kind = 'method' and owner <> ''").select(type_id(c("source_file"), c("owner")).alias("of"), name(), method).unionByName(extended.join(own, ["source_file", "namespace", "owner"]).select("of", name(), method)).distinct()
    k = calls.join(bound, ["source_file", "namespace", "uname"]).select(F.concat(type_id(c("source_file"), c("owner")), F.lit("."), "member").alias("src"), "type", name(), (c("receiver") == "<super>").alias("above")).distinct()
    reach = up.select("type", c("above").alias("of"), "dist").unionByName(k.select("type").distinct().select("type", c("type").alias("of"), F.lit(0).alias("dist")))
    hits = k.join(reach, "type").where(~c("above") | (c("dist") > 0)).join(methods, ["of", "key"])
    near = hits.groupBy("src", "type", "key", "dist").agg(F.count_distinct("method").alias("n"), F.min("method").alias("method"))
    first = near.groupBy("src", "type", "key").agg(F.min_by(F.struct("n", "method"), "dist").alias("b")).where("b.n = 1")
    return first.select("src", c("b.method").alias("tgt"), F.lit("calls").alias("relation")).where("src <> tgt").distinct()


def module_calls(rows: DataFrame, language: str) -> DataFrame:
    """JN18, JN19: (src, tgt, relation): calls of imported names, by the module that an import names.

    A module is the file whose path, without its extension and a last __init__, mod, lib or main,
    ends with the module's name; it binds if one file does.
    """
    c = F.col
    r = rows.where(c("language") == language)
    parts = F.filter(F.split(F.regexp_replace("source_file", r"(/(__init__|mod|lib|main))?\.[^./]*$", ""), "/"), lambda p: p != "src")
    files = r.select("source_file").distinct().withColumn("p", parts)
    ends = files.select("source_file", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", -k, k), "."))).alias("module"))
    lone = ends.groupBy("module").agg(F.count("*").alias("n"), F.min("source_file").alias("mfile")).where("n = 1").select("module", "mfile")
    imports = r.where("kind = 'import'").select("source_file", "owner", "name", c("receiver").alias("alias"), "relation")
    from_ = imports.where("relation = 'name'").join(lone, c("owner") == c("module")).select("source_file", "alias", "mfile", "name")
    whole = imports.withColumn("m", F.when((c("relation") == "module") | (c("owner") == ""), c("name")).otherwise(F.concat("owner", F.lit("."), "name"))).join(lone, c("m") == c("module")).select("source_file", "alias", "mfile")
    defs = r.where("kind in ('method', 'type') and owner = ''").select(c("source_file").alias("mfile"), "name").distinct()
    calls = r.where("kind = 'call'").select("source_file", F.concat("source_file", F.lit("#"), F.when(c("owner") == "", c("member")).otherwise(F.concat("owner", F.lit("."), "member"))).alias("src"), "name", "receiver")
    plain = calls.where("receiver = ''").select("source_file", "src", c("name").alias("alias")).join(from_, ["source_file", "alias"]).select("src", "mfile", "name")
    dotted = calls.where("receiver <> ''").select("source_file", "src", c("receiver").alias("alias"), "name").join(whole, ["source_file", "alias"]).select("src", "mfile", "name")
    hits = plain.unionByName(dotted).join(defs, ["mfile", "name"], "left_semi").distinct()
    lone_hit = hits.select("src", F.concat("mfile", F.lit("#"), "name").alias("tgt"), F.lit("calls").alias("relation"))
    return lone_hit.where("src <> tgt").distinct()


def resolve(rows: DataFrame) -> DataFrame:
    """(src, tgt, relation) of all languages: bases, typed calls and calls of imported names."""
    rows = cut(rows)
    links = cut(bases(rows))
    return links.unionByName(typed_calls(rows, links)).unionByName(module_calls(rows, "python")).unionByName(module_calls(rows, "rust"))
