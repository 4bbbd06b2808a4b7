"""Discovery of files: classification, ignore rules, sensitive and noisy paths, binary inventories, coverage."""

from __future__ import annotations

import io
import json
import re
import struct
import tarfile
import tomllib
import zipfile
from collections.abc import Iterator
from fnmatch import translate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import lookup
from tessera.operators.analysis import CODE, extension
from tessera.sources.documents import Facts

# Endings of document and media files, folders of dependencies and builds, first bytes of formats.
DOCUMENTS = "md markdown txt rst adoc asciidoc html htm org tex docx xlsx pptx odt ods odp rtf epub csv tsv yaml yml toml xml ini".split()
MEDIA = {"pdf": "paper"} | dict.fromkeys("png jpg jpeg gif webp svg bmp tiff".split(), "image") | dict.fromkeys("mp4 mov mkv webm mp3 wav flac m4a ogg".split(), "video")
NOISE = "node_modules .git .hg .svn __pycache__ .venv venv dist build target .next .nuxt .tox .mypy_cache .pytest_cache .ruff_cache site-packages vendor .gradle .idea .vscode coverage".split()
MAGIC = {"89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "47494638": "gif", "25504446": "pdf", "504B0304": "zip", "1F8B": "gzip", "7F454C46": "elf", "50415231": "parquet", "4F626A01": "avro", "4F5243": "orc", "7B5C727466": "rtf"}
SENSITIVE_PATH = r"(?i)(^|/)(\.env(\.[^/]*)?|\.netrc|\.pgpass|\.npmrc|\.pypirc|id_(rsa|dsa|ecdsa|ed25519)|credentials(\.[^/]*)?|secrets?(\.[^/]*)?|[^/]*\.(pem|key|p12|pfx|jks|keystore|kdbx))$"


def classify(path: Column) -> Column:
    """SRC7: code, document, paper, image or video by extension; null for other files."""
    kinds = dict.fromkeys(CODE, "code") | dict.fromkeys(DOCUMENTS, "document") | MEDIA
    return lookup(extension(path), kinds)


def is_sensitive_path(path: Column) -> Column:
    """SRC13: a file that holds credentials by its name; it is dropped before its content is read."""
    return path.rlike(SENSITIVE_PATH)


def is_noise(path: Column) -> Column:
    """SRC14: a path below a folder of dependencies, builds or caches."""
    return path.rlike("(^|/)(" + "|".join(re.escape(n) for n in NOISE) + ")/")


def sniff(content: Column) -> Column:
    """SRC8: the format by the first bytes, or null."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for bytes_, name in MAGIC.items():
        out = F.when(F.startswith(head, F.lit(bytes_)), name).otherwise(out)
    return out


def ignore_patterns(lines: list[str], base: str = "") -> list[tuple[str, bool]]:
    """SRC11: (regular expression, whether it brings files back) of ignore rules, in order."""
    out = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back, rule = line.startswith("!"), line.lstrip("!")
        anchored = rule.startswith("/") or "/" in rule.rstrip("/")
        body = translate(rule.strip("/")).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*.*", "\0").replace(".*", "[^/]*").replace("\0", ".*")
        out.append((f"^{re.escape(base)}{'' if anchored else '(?:.*/)?'}{body}(?:/.*)?$", back))
    return out


def is_ignored(path: Column, patterns: list[tuple[str, bool]]) -> Column:
    """SRC12: the last rule that fits a path decides."""
    out = F.lit(False)
    for expression, back in patterns:
        out = F.when(path.rlike(expression), F.lit(not back)).otherwise(out)
    return out


def discover(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """SRC6, SRC57: (path, relative, kind, status, length, modified) of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")
    files = files.withColumn("relative", rel).withColumn("kind", classify(F.col("relative")))
    status = (
        F.when(is_ignored(F.col("relative"), ignore_patterns(list(ignore))), "excluded_ignored").when(is_noise(F.col("relative")), "excluded_noise")
        .when(is_sensitive_path(F.col("relative")), "excluded_sensitive").when(F.col("kind").isNull(), "unsupported")
        .when(F.col("kind").isin("image", "video", "paper"), "inventory_only").otherwise("covered")
    )
    return files.select("path", "relative", "kind", status.alias("status"), "length", "modified")


def coverage(found: DataFrame) -> DataFrame:
    """AGG27: (status, n)."""
    return found.groupBy("status").agg(F.count("*").alias("n"))


def archive_members(f: Facts, content: bytes, depth: int = 2) -> None:
    """SRC53: members of ZIP and TAR archives, nested ones to a depth; contents aren't kept."""
    try:
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for m in z.infolist():
                    f.child(f.file, m.filename, m.filename, "archive_member")
                    if depth > 1 and m.filename.endswith((".zip", ".jar", ".tar")) and m.file_size < 1 << 26:
                        inner = Facts(f"{f.file}#{m.filename}")
                        archive_members(inner, z.read(m), depth - 1)
                        f.rows += inner.rows[1:]
            return
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                f.child(f.file, m.name, m.name, "archive_member")
    except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as e:
        f.problem("bad_archive", str(e))


def office_units(f: Facts, content: bytes) -> None:
    """SRC51: paragraphs, sheets and slides of OOXML, ODF and EPUB packages."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(z.namelist()):
                if re.search(r"(word/document|ppt/slides/slide\d+|xl/sharedStrings|^content)\.xml$|\.x?html$", name):
                    xml = z.read(name).decode("utf-8", "replace")
                    for i, p in enumerate(re.findall(r"<(?:\w+:)?(?:p|si|h)\b[^>]*>(.*?)</(?:\w+:)?(?:p|si|h)>", xml, re.S)):
                        if text := re.sub(r"<[^>]+>", "", p).strip():
                            f.child(f.file, f"{name}[{i}]", text, "document_unit")
    except (zipfile.BadZipFile, OSError) as e:
        f.problem("bad_package", str(e))


def rtf_paragraphs(f: Facts, text: str) -> None:
    """SRC52: paragraphs of an RTF text, without control words and groups that aren't shown."""
    body = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    for i, p in enumerate(re.split(r"\\par\b", body)):
        if plain := re.sub(r"\\'[0-9a-fA-F]{2}|\\[a-z]+-?\d* ?|[{}]", "", p).strip():
            f.child(f.file, f"par{i}", plain, "document_unit")


def image_header(content: bytes) -> dict[str, int]:
    """SRC54: width and height from the header of a PNG or GIF."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return dict(zip(("width", "height"), struct.unpack(">II", content[16:24])))
    if content[:4] == b"GIF8" and len(content) >= 10:
        return dict(zip(("width", "height"), struct.unpack("<HH", content[6:10])))
    return {}


def package_manifest(f: Facts, text: str) -> None:
    """SRC36, SRC37: the package of a manifest by its declared name, and what it depends on."""
    name = f.file.rsplit("/", 1)[-1].lower()
    if name == "package.json":
        m = json.loads(text)
        own, needs = m.get("name"), [d for k in ("dependencies", "devDependencies", "peerDependencies") for d in m.get(k) or {}]
    elif name in ("cargo.toml", "pyproject.toml"):
        m = tomllib.loads(text)
        p = m.get("package") or m.get("project") or {}
        own, needs = p.get("name"), list(m.get("dependencies") or {}) + [re.split(r"[\s<>=!~;\[]", d)[0] for d in p.get("dependencies") or []]
    elif name == "go.mod":
        own = (re.search(r"^module\s+(\S+)", text, re.M) or [None, None])[1]
        needs = re.findall(r"^(?:require\s+|\s+)([\w./-]+\.[\w./-]+)\s+v", text, re.M)
    else:
        own, needs = None, [x for x in re.findall(r"^([A-Za-z][\w.-]*)", text, re.M)]
    if own:
        f.rows.append(("node", f"package:{own}", own, "package", f.file, 1))
    for n in needs:
        f.edge(f"package:{own}" if own else f.file, f"package:{n}", "depends_on")


def mcp_config(f: Facts, text: str) -> None:
    """SRC39: servers with commands, packages and names of variables; their values are left out."""
    servers = json.loads(text)
    for name, s in (servers.get("mcpServers") or servers.get("servers") or {}).items():
        at = f.child(f.file, f"server.{name}", name, "mcp_server")
        if s.get("command"):
            f.child(at, f"server.{name}.command", str(s["command"]), "mcp_command")
        for arg in s.get("args") or []:
            if re.fullmatch(r"@?[\w.-]+(?:/[\w.-]+)?(?:@[\w.-]+)?", str(arg)) and not str(arg).startswith("-"):
                f.edge(at, f"package:{arg}", "requires")
        for k in s.get("env") or {}:
            f.child(at, f"server.{name}.env.{k}", k, "mcp_env")


def openapi(f: Facts, doc: dict) -> None:
    """SRC44, SRC45: paths with operations or channels, components, and references between them."""
    for kind, top in (("api_path", "paths"), ("api_channel", "channels")):
        for path, ops in (doc.get(top) or {}).items():
            at = f.child(f.file, path, path, kind)
            for op, body in (ops or {}).items():
                if op in ("get", "put", "post", "delete", "patch", "head", "options", "trace", "publish", "subscribe"):
                    here = f.child(at, f"{op} {path}", f"{op.upper()} {path}", "api_operation")
                    for ref in sorted(set(re.findall(r'"\$ref": "#/([^"]+)"', json.dumps(body)))):
                        f.edge(here, f"{f.file}#{ref}", "type_ref")
    for group, items in (doc.get("components") or {}).items():
        for name in items or {}:
            f.child(f.file, f"components/{group}/{name}", name, "api_component")


def columnar_schema(spark: SparkSession, path: str) -> DataFrame:
    """SRC41: (field, type, parent) of a Parquet or ORC file's schema; no value is read."""
    rows: list[tuple[str, str, str]] = []

    def walk(kind, at: str) -> None:
        fields = getattr(kind, "fields", None) or getattr(getattr(kind, "elementType", None), "fields", None) or []
        for x in fields:
            name = f"{at}.{x.name}" if at else x.name
            rows.append((name, x.dataType.simpleString(), at))
            walk(x.dataType, name)

    walk(spark.read.format("orc" if path.endswith(".orc") else "parquet").load(path).schema, "")
    return spark.createDataFrame(rows, "field string, type string, parent string")


def catalog_facts(tables: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC34: nodes of (schema, name, kind) rows and references of foreign keys (schema, name, to_schema, to_name)."""
    id_ = lambda s, n: F.concat(F.lit("pg:"), F.col(s), F.lit("."), F.col(n))
    nodes = tables.select(id_("schema", "name").alias("id"), F.col("name").alias("label"), F.col("kind").alias("file_type"))
    return nodes, keys.select(id_("schema", "name").alias("src"), id_("to_schema", "to_name").alias("tgt"), F.lit("references").alias("relation")).distinct()


def scip_facts(documents: DataFrame) -> DataFrame:
    """SRC35: (src, tgt, relation) from index documents (path, symbols of symbol, relationships of symbol and kind)."""
    s = documents.select("path", F.explode("symbols").alias("s"))
    own = s.select(F.col("path").alias("src"), F.col("s.symbol").alias("tgt"), F.lit("contains").alias("relation"))
    rel = s.select(F.col("s.symbol").alias("src"), F.explode("s.relationships").alias("r")).select("src", F.col("r.symbol").alias("tgt"), F.when(F.col("r.is_implementation"), "implements").otherwise("references").alias("relation"))
    return own.unionByName(rel)


def binary_facts(files: DataFrame) -> DataFrame:
    """SRC50 to SRC54: facts of archives, packages and images by what their first bytes say."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            for p, c in zip(t["path"], t["content"]):
                f, data = Facts(p), bytes(c)
                if p.endswith((".docx", ".pptx", ".xlsx", ".odt", ".ods", ".odp", ".epub")):
                    office_units(f, data)
                elif p.endswith(".rtf"):
                    rtf_paragraphs(f, data.decode("latin-1"))
                elif data[:2] == b"PK" or p.endswith((".tar", ".tgz", ".tar.gz")):
                    archive_members(f, data)
                else:
                    for k, v in image_header(data).items():
                        f.child(f.file, k, f"{k} {v}", "media_property")
                yield pd.DataFrame([(p, *r) for r in f.rows], columns=["source_file", "kind", "id", "label", "type", "parent", "line"])

    from tessera.sources.documents import SCHEMA

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def api_document(f: Facts, text: str) -> None:
    """An OpenAPI or AsyncAPI description in JSON: its paths or channels, besides the tree."""
    doc = json.loads(text)
    if isinstance(doc, dict) and ("openapi" in doc or "swagger" in doc or "asyncapi" in doc):
        openapi(f, doc)


#: Parsers of files that their whole name tells.
NAMED = {
    **dict.fromkeys(("package.json", "cargo.toml", "pyproject.toml", "go.mod", "requirements.txt"), package_manifest),
    **dict.fromkeys((".mcp.json", "mcp.json", "mcp_servers.json"), mcp_config),
    **dict.fromkeys(("openapi.json", "swagger.json", "asyncapi.json"), api_document),
}
