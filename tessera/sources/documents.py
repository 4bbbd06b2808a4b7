"""Facts from files: one parser a format, dispatched by extension inside mapInPandas.

A fact is (kind, id, label, type, parent, line).  Kind is node or edge; an edge's type is its
relation, its id the source and its parent the target.  A parser gets the whole text; what it can't
parse becomes a fact of kind diagnostic, so that a bad file never stops a job.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.sensitive import key_is_sensitive, value_is_sensitive

SCHEMA = "source_file string, kind string, id string, label string, type string, parent string, line long"
REDACTED = "<redacted>"
Fact = tuple[str, str, str, str, str, int]


class Facts:
    """Collects the facts of one file."""

    def __init__(self, file: str):
        self.file, self.rows = file, []
        self.rows.append(("node", file, file.rsplit("/", 1)[-1], "file", "", 1))

    def child(self, parent: str, path: str, label: str, kind: str, line: int = 1) -> str:
        id_ = f"{self.file}#{path}"
        self.rows.append(("node", id_, label[:512], kind, parent, line))
        self.edge(parent, id_, "contains", line)
        return id_

    def edge(self, source: str, target: str, relation: str, line: int = 1) -> None:
        self.rows.append(("edge", source, "", relation, target, line))

    def problem(self, code: str, text: str, line: int = 1) -> None:
        self.rows.append(("diagnostic", f"{self.file}!{code}", text[:512], code, self.file, line))


def _value(f: Facts, parent: str, path: str, value, key: str = "") -> None:
    """SRC18: a JSON-like value as a tree; sensitive values are redacted."""
    if isinstance(value, dict):
        for k, v in value.items():
            at = f.child(parent, f"{path}.{k}", str(k), "object_key" if isinstance(v, (dict, list)) else "scalar")
            _value(f, at, f"{path}.{k}", v, str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            at = f.child(parent, f"{path}[{i}]", f"[{i}]", "element")
            _value(f, at, f"{path}[{i}]", v, key)
    else:
        text = "null" if value is None else json.dumps(value) if isinstance(value, bool) else str(value)
        hidden = key_is_sensitive(key) or value_is_sensitive(text)
        f.child(parent, f"{path}=", REDACTED if hidden else text, "value")


def strip_json_comments(text: str) -> str:
    """FN57: JSON with comments and trailing commas as plain JSON; strings stay as they are."""
    out = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', lambda m: m[0] if m[0][0] == '"' else " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], out)


def parse_json(f: Facts, text: str) -> None:
    _value(f, f.file, "$", json.loads(strip_json_comments(text)))


def parse_json_lines(f: Facts, text: str) -> None:
    """SRC20: a record a line; bad lines are diagnostics."""
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                value = json.loads(line)
            except ValueError as e:
                f.problem("invalid_json", str(e), n)
                continue
            _value(f, f.child(f.file, f"$[{n - 1}]", f"record {n}", "record", n), f"$[{n - 1}]", value)


def parse_toml(f: Facts, text: str) -> None:
    """SRC21: a typed tree of tables and values."""
    _value(f, f.file, "$", tomllib.loads(text))


def parse_yaml(f: Facts, text: str) -> None:
    """SRC22: the nesting of keys and items by indentation, without a full loader."""
    stack: list[tuple[int, str]] = [(-1, f.file)]
    for n, line in enumerate(text.splitlines(), 1):
        m = re.match(r"(\s*)(- )?(?:([\w.\-/ ]+|\"[^\"]*\"):(?:\s+(.*))?|(.*))$", line)
        if not line.strip() or line.lstrip().startswith("#") or not m:
            continue
        indent = len(m[1])
        while stack[-1][0] >= indent:
            stack.pop()
        label = (m[3] or m[5] or "").strip().strip('"')
        if label:
            at = f.child(stack[-1][1], f"line{n}", label, "key" if m[3] else "item", n)
            if m[3]:
                stack.append((indent + (1 if m[2] else 0), at))
            if m[4]:
                f.child(at, f"line{n}=", REDACTED if key_is_sensitive(label) or value_is_sensitive(m[4]) else m[4].strip(), "value", n)


def parse_xml(f: Facts, text: str) -> None:
    """SRC23: elements, attributes and texts."""
    if re.search(r"<!(DOCTYPE|ENTITY)", text):
        f.problem("doctype", "document types aren't read")
        return

    def walk(e: ET.Element, parent: str, path: str) -> None:
        at = f.child(parent, path, e.tag, "element")
        for k, v in e.attrib.items():
            f.child(at, f"{path}@{k}", f"{k}={REDACTED if key_is_sensitive(k) or value_is_sensitive(v) else v}", "attribute")
        if e.text and e.text.strip():
            f.child(at, f"{path}/text()", REDACTED if value_is_sensitive(e.text) else e.text.strip(), "text")
        for i, c in enumerate(e):
            walk(c, at, f"{path}/{i}")

    walk(ET.fromstring(text), f.file, "/0")


def parse_delimited(delimiter: str) -> Callable[[Facts, str], None]:
    def parse(f: Facts, text: str) -> None:
        """SRC24: header, rows and cells; columns of sensitive names are redacted."""
        heads: list[str] = []
        for n, row in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter)):
            if n == 0:
                heads = [h or f"column {i}" for i, h in enumerate(row)]
                top = f.child(f.file, "$headers", "headers", "table_header")
                for i, h in enumerate(heads):
                    f.child(top, f"$headers[{i}]", h, "column")
                continue
            at = f.child(f.file, f"$row[{n - 1}]", f"row {n}", "row", n + 1)
            for i, cell in enumerate(row):
                head = heads[i] if i < len(heads) else f"column {i}"
                f.child(at, f"$row[{n - 1}][{i}]", REDACTED if key_is_sensitive(head) or value_is_sensitive(cell) else cell, "cell", n + 1)

    return parse


def parse_ini(f: Facts, text: str) -> None:
    """SRC25: sections with keys and values."""
    section = f.file
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line[0] in "#;!":
            continue
        if line[0] == "[" and line[-1] == "]":
            section = f.child(f.file, f"[{line[1:-1]}]", line[1:-1], "section", n)
        elif m := re.match(r"(?:export\s+)?([^=:]+?)\s*[=:]\s*(.*)", line):
            at = f.child(section, f"line{n}", m[1], "key", n)
            f.child(at, f"line{n}=", REDACTED if key_is_sensitive(m[1]) or value_is_sensitive(m[2]) else m[2], "value", n)


def _headings(f: Facts, found: Iterator[tuple[int, int, str]]) -> str:
    """A tree of (level, line, label); gives the last heading."""
    stack: list[tuple[int, str]] = []
    for level, n, label in found:
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, f.child(stack[-1][1] if stack else f.file, f"$heading[{n}]", label, "document_heading", n)))
    return stack[-1][1] if stack else f.file


def reference(f: Facts, source: str, target: str, line: int) -> None:
    """SRC30: a link's target, unless it is empty or holds data."""
    target = target.strip()
    if target and not target.lower().startswith("data:"):
        f.rows.append(("node", f"ref:{target}", target[:512], "document_reference", "", line))
        f.edge(source, f"ref:{target}", "references", line)


def parse_markdown(f: Facts, text: str) -> None:
    """SRC26, SRC31: headings as a tree, code fences, links at the heading they stand under."""
    stack: list[tuple[int, str]] = []
    fence = False
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if line.startswith(("```", "~~~")):
            fence = not fence
            if language := line.lstrip("`~").strip():
                f.child(f.file, f"$code[{n}]", language, "code_fence", n)
            continue
        if fence:
            continue
        if m := re.match(r"(#{1,6})\s(.*)", line):
            label = m[2].strip().rstrip("#").strip()
            if label:
                while stack and stack[-1][0] >= len(m[1]):
                    stack.pop()
                stack.append((len(m[1]), f.child(stack[-1][1] if stack else f.file, f"$heading[{n}]", label, "document_heading", n)))
        for target in re.findall(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)|\[\[([^\]|]+)", line):
            reference(f, stack[-1][1] if stack else f.file, target[0] or target[1], n)


def parse_rst(f: Facts, text: str) -> None:
    """SRC27: underlined headings by the order of their marks, directives and links."""
    lines, marks, found = text.splitlines(), [], []
    for n, line in enumerate(lines[:-1], 1):
        under = lines[n]
        if line.strip() and len(under) >= len(line.rstrip()) >= 1 and re.fullmatch(r"([=\-~^\"'`#*+.:_])\1+", under):
            if under[0] not in marks:
                marks.append(under[0])
            found.append((marks.index(under[0]) + 1, n, line.strip()))
        if m := re.match(r"\.\. ([\w-]+)::\s*(.*)", line):
            f.child(f.file, f"$directive[{n}]", f"{m[1]} {m[2]}".strip(), "directive", n)
    last = _headings(f, iter(found))
    for n, line in enumerate(lines, 1):
        for target in re.findall(r"`[^`<]*<([^>]+)>`_", line):
            reference(f, last, target, n)


def parse_asciidoc(f: Facts, text: str) -> None:
    """SRC28: = headings and link: targets."""
    found = [(len(m[1]), n, m[2].strip()) for n, line in enumerate(text.splitlines(), 1) if (m := re.match(r"(={1,6})\s+(.+)", line))]
    last = _headings(f, iter(found))
    for n, line in enumerate(text.splitlines(), 1):
        for target in re.findall(r"link:([^\[\s]+)", line):
            reference(f, last, target, n)


def parse_html(f: Facts, text: str) -> None:
    """SRC29: headings as a tree; every link is at the last heading."""
    found = []
    for m in re.finditer(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", text, re.I | re.S):
        if label := re.sub(r"<[^>]*>", "", m[2]).strip():
            found.append((int(m[1]), text.count("\n", 0, m.start(2)) + 1, label))
    last = _headings(f, iter(found))
    for m in re.finditer(r"""href\s*=\s*["']([^"']*)["']""", text, re.I):
        reference(f, last, m[1], text.count("\n", 0, m.start(1)) + 1)


def mask_sql(text: str) -> str:
    """SRC33: comments and strings blanked, places kept."""
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'|\$(\w*)\$.*?\$\1\$", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def parse_sql(f: Facts, text: str) -> None:
    """SRC32: tables, views and routines; what views read and foreign keys reference."""
    clean, name = mask_sql(text), r'((?:["\w]+\.)*["\w]+)'
    tidy = lambda s: s.replace('"', "").lower()
    for m in re.finditer(rf"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?{name}", clean, re.I):
        end = clean.find(";", m.end())
        body, n = clean[m.end() : end if end >= 0 else len(clean)], clean.count("\n", 0, m.start()) + 1
        at = f.child(f.file, tidy(m[2]), tidy(m[2]), f"sql_{m[1].lower()}", n)
        if m[1].lower() == "table":
            for r in re.finditer(rf"references\s+{name}", body, re.I):
                f.edge(at, f"{f.file}#{tidy(r[1])}", "references", n)
        else:
            for r in re.finditer(rf"(?:from|join)\s+{name}", body, re.I):
                f.edge(at, f"{f.file}#{tidy(r[1])}", "reads_from", n)


def parse_dot(f: Facts, text: str) -> None:
    """SRC46: nodes, edge chains and subgraphs of the common DOT forms; self loops stay."""
    clean = re.sub(r"//[^\n]*|/\*.*?\*/|^#[^\n]*", " ", text, flags=re.S | re.M)
    ident = r'(?:"(?:\\.|[^"\\])*"|[A-Za-z_\x80-\uffff][\w\x80-\uffff]*|-?\d+(?:\.\d+)?)'
    seen: set[str] = set()

    def node(raw: str) -> str:
        label = raw.strip('"')
        if label not in seen:
            seen.add(label)
            f.child(f.file, label, label, "dot_node")
        return f"{f.file}#{label}"

    for m in re.finditer(rf"subgraph\s+({ident})", clean):
        f.child(f.file, f"subgraph {m[1]}", m[1].strip('"'), "dot_subgraph")
    body = re.sub(r"\[[^\]]*\]", " ", clean[clean.find("{") + 1 :])
    for statement in re.split(r"[;\n{}]", body):
        parts = [p.strip() for p in re.split(r"->|--", statement)]
        if all(re.fullmatch(rf"{ident}(?::\w+)*", p) for p in parts) and parts[0] not in ("node", "edge", "graph", "subgraph"):
            ids = [node(re.match(ident, p)[0]) for p in parts]
            for a, b in zip(ids, ids[1:]):
                f.edge(a, b, "flows_to")


def parse_terraform(f: Facts, text: str) -> None:
    """SRC40: blocks by kind and name, and the references between them."""
    clean = re.sub(r"#[^\n]*|//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    blocks = []
    for m in re.finditer(r'^(resource|data|module|variable|output|provider)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{', clean, re.M):
        name = {"resource": f"{m[2]}.{m[3]}", "data": f"data.{m[2]}.{m[3]}", "variable": f"var.{m[2]}"}.get(m[1], f"{m[1]}.{m[2]}")
        depth, end = 1, m.end()
        while end < len(clean) and depth:
            depth += {"{": 1, "}": -1}.get(clean[end], 0)
            end += 1
        blocks.append((f.child(f.file, name, name, f"terraform_{m[1]}", clean.count("\n", 0, m.start()) + 1), name, clean[m.end() : end]))
    known = {name: at for at, name, _ in blocks}
    for at, name, body in blocks:
        for ref in sorted(set(re.findall(r"\b(?:data\.)?[A-Za-z_]\w*\.[A-Za-z_][\w-]*", body))):
            if ref in known and ref != name:
                f.edge(at, known[ref], "references")


def parse_idl(f: Facts, text: str) -> None:
    """SRC42: declarations and imports of protobuf, thrift, flatbuffers, GraphQL and the like."""
    clean = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    for n, line in enumerate(clean.splitlines(), 1):
        if m := re.match(r'\s*(?:import|include|using)\s+(?:public\s+)?["<]?([\w./-]+)', line):
            f.edge(f.file, f"import:{m[1]}", "imports", n)
        for m in re.finditer(r"\b(message|service|enum|struct|table|union|exception|interface|type|input|scalar|protocol|record|rpc)\s+([A-Za-z_]\w*)", line):
            f.child(f.file, f"{m[1]} {m[2]}", m[2], f"idl_{m[1]}", n)


def parse_avro(f: Facts, text: str) -> None:
    """SRC43: records with fields, and the named types that fields refer to."""
    def walk(s, parent: str) -> None:
        if isinstance(s, list):
            for x in s:
                walk(x, parent)
        elif isinstance(s, dict):
            if s.get("type") in ("record", "enum", "fixed", "error") and "name" in s:
                at = f.child(parent, s["name"], s["name"], f"avro_{s['type']}")
                for field in s.get("fields", []):
                    here = f.child(at, f"{s['name']}.{field['name']}", field["name"], "avro_field")
                    walk(field.get("type"), here)
            else:
                for k in ("type", "items", "values"):
                    walk(s.get(k), parent)
        elif isinstance(s, str) and s not in ("null", "boolean", "int", "long", "float", "double", "bytes", "string", "array", "map"):
            f.edge(parent, f"{f.file}#{s}", "type_ref")

    walk(json.loads(text), f.file)


def parse_python(f: Facts, text: str) -> None:
    """UDF1: classes, functions, imports, bases and calls inside the file."""
    tree = ast.parse(text)
    defs: dict[str, str] = {}

    def declare(body, parent: str, prefix: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{n.name}"
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if prefix else "function"
                at = f"{f.file}#{name}"
                f.rows.append(("node", at, n.name if kind == "class" else f"{n.name}()", kind, parent, n.lineno))
                f.edge(parent, at, "method" if kind == "method" else "contains", n.lineno)
                defs.setdefault(n.name, at)
                declare(n.body, at, f"{name}.")

    declare(tree.body, f.file, "")
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                f.edge(f.file, f"module:{a.name}", "imports", n.lineno)
        elif isinstance(n, ast.ImportFrom):
            f.edge(f.file, f"module:{'.' * n.level}{n.module or ''}", "imports_from", n.lineno)

    def calls(body, prefix: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                at = f"{f.file}#{prefix}{n.name}"
                if isinstance(n, ast.ClassDef):
                    for b in n.bases:
                        if isinstance(b, ast.Name):
                            f.edge(at, defs.get(b.id, f"name:{b.id}"), "inherits", n.lineno)
                else:
                    for c in ast.walk(n):
                        called = c.func.id if isinstance(c, ast.Call) and isinstance(c.func, ast.Name) else c.func.attr if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute) else None
                        if called in defs and defs[called] != at:
                            f.edge(at, defs[called], "calls", c.lineno)
                calls(n.body, f"{prefix}{n.name}.")

    calls(tree.body, "")


def parse_code(f: Facts, text: str) -> None:
    """UDF1: declarations and imports of other languages, by patterns."""
    for n, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*(?:(?:pub|public|private|protected|static|export|default|abstract|final|async|internal|open|override|sealed|data)\s+)*(class|interface|trait|struct|enum|object|module|fn|func|function|def|fun|sub|proc)\s+([A-Za-z_]\w*)", line):
            call = m[1] in ("fn", "func", "function", "def", "fun", "sub", "proc")
            f.child(f.file, m[2], f"{m[2]}()" if call else m[2], "function" if call else "class", n)
        elif m := re.match(r"\s*(?:import|use|require|include|using|from|#include)\b[\s(\"'<]*([\w./:@-]+)", line):
            f.edge(f.file, f"module:{m[1]}", "imports", n)


def parse_text(f: Facts, text: str) -> None:
    """SRC56: a file without a parser is only listed."""


PARSERS: dict[str, Callable[[Facts, str], None]] = {
    "json": parse_json, "jsonc": parse_json, "geojson": parse_json, "jsonl": parse_json_lines, "ndjson": parse_json_lines, "toml": parse_toml, "yaml": parse_yaml, "yml": parse_yaml,
    "xml": parse_xml, "svg": parse_xml, "csv": parse_delimited(","), "tsv": parse_delimited("\t"), "psv": parse_delimited("|"), "ini": parse_ini, "cfg": parse_ini, "properties": parse_ini, "env": parse_ini,
    "md": parse_markdown, "markdown": parse_markdown, "rst": parse_rst, "adoc": parse_asciidoc, "asciidoc": parse_asciidoc, "html": parse_html, "htm": parse_html, "sql": parse_sql, "dot": parse_dot, "gv": parse_dot,
    "tf": parse_terraform, "hcl": parse_terraform, "proto": parse_idl, "thrift": parse_idl, "fbs": parse_idl, "graphql": parse_idl, "capnp": parse_idl, "avsc": parse_avro, "py": parse_python, "pyw": parse_python,
    **dict.fromkeys("js jsx ts tsx mjs go rs java kt scala c h cpp hpp cc cs rb php swift dart lua r jl ex exs sh bash pl ps1 groovy f90 pas sv vue svelte".split(), parse_code),
}


def _parser(name: str) -> Callable[[Facts, str], None]:
    """The parser of a file name: of the whole name first, then of its extension."""
    from tessera.sources.diagrams import DIAGRAMS
    from tessera.sources.engineering import ENGINEERING
    from tessera.sources.files import NAMED

    end = name.rsplit(".", 1)[-1] if "." in name else name
    return NAMED.get(name) or DIAGRAMS.get(end) or ENGINEERING.get(end) or PARSERS.get(end, parse_text)


def extract(path: str, content: bytes) -> list[Fact]:
    """SRC55: all facts of one file."""
    f = Facts(path)
    name = path.rsplit("/", 1)[-1].lower()
    parser = _parser(name)
    try:
        parser(f, content.decode("utf-8"))
    except UnicodeDecodeError as e:
        f.problem("invalid_utf8", str(e))
    except (ValueError, SyntaxError, ET.ParseError, csv.Error, RecursionError) as e:
        f.problem("invalid", f"{type(e).__name__}: {e}")
    return f.rows


def facts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The facts of a table of files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            for p, c in zip(t["path"], t["content"]):
                rows = extract(p, bytes(c) if c is not None else b"")
                yield pd.DataFrame([(p, *r) for r in rows], columns=["source_file", "kind", "id", "label", "type", "parent", "line"])

    return files.selectExpr(f"`{path}` AS path", f"CAST(`{content}` AS BINARY) AS content").mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC6: (path, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
