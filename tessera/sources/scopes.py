"""Scopes of programs: types, methods, bases, imports and calls with what is known of their receivers.

Scanners follow braces (in Ruby and Pascal keywords, in Python the parser) over text whose comments
and strings are blanked.  They bind nothing: operators/languages.py joins their rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = ["source_file", "language", "kind", "namespace", "owner", "member", "name", "receiver", "relation", "line"]
SCHEMA = "source_file string, language string, kind string, namespace string, owner string, member string, name string, receiver string, relation string, line long"

# Languages of extensions, and words that look like calls or names but are none.
LANGUAGES = {
    "java": "java", "groovy": "java", "kt": "java", "scala": "java", "cs": "csharp", "php": "php", "rb": "ruby", "swift": "swift", "pas": "pascal", "dpr": "pascal",
    "h": "native", "hpp": "native", "cc": "native", "cpp": "native", "m": "native", "dart": "dart", "py": "python", "rs": "rust",
}
KEYWORDS = frozenset("if for while switch catch return new throw else do case using lock foreach when match sizeof typeof super this self function fn func def guard init assert and or not unless until elsif then begin end yield puts nil true false".split())

_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_HASH = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_PASCAL = re.compile(r"//[^\n]*|\{[^}]*\}|\(\*.*?\*\)|'(?:''|[^'\n])*'", re.S)
_TYPE = re.compile(r"(?<![\w.:])(class|interface|trait|struct|protocol|object|enum|record|mixin|extension)\s+([A-Za-z_]\w*)([^{;]*)")
_NAME = r"[A-Za-z_]\w*"
_CALL = re.compile(rf"(?<![\w$.>:])(?:(?:\$?this|self)\s*(?:\.|->)\s*)?(?:(\$?{_NAME})(?:<[^<>()]*>)?\s*(?:\.|->|::|\?\.)\s*)?({_NAME})\s*\(")
_THIS = re.compile(rf"(?<![\w$.>:])(?:\$?this|self)\s*(?:\.|->)\s*({_NAME})\s*\(")
_TYPED = re.compile(rf"(?<![\w.])([A-Z]\w*)(?:<[^<>]*>)?[\s*&]+\$?({_NAME})\s*(?=[;=,)])")
_COLON = re.compile(rf"(?<![\w.])({_NAME})\s*:\s*([A-Z]\w*)")


def blank(text: str, pattern: re.Pattern) -> str:
    """The text with matches as blanks, lines kept."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _bases(head: str, keyword: str, language: str) -> list[tuple[str, str]]:
    """(relation, base) of what follows the name of a type."""
    head = re.sub(r"\([^()]*\)|<[^<>]*>", " ", head)
    out = []
    for word, names in re.findall(r"(extends|implements|with|:)([^:]*?)(?=\bextends\b|\bimplements\b|\bwith\b|\bwhere\b|$)", head, re.S):
        for i, x in enumerate(names.split(",")):
            x = re.sub(r"\b(public|private|protected|virtual)\b", "", x).strip()
            if re.fullmatch(r"[\w.\\]+", x):
                relation = "implements" if word == "implements" or word == ":" and language == "csharp" and re.match(r"I[A-Z]", x) else "mixes_in" if word == "with" else "inherits"
                out.append((relation, x))
    return out


class Scan:
    def __init__(self, file: str, language: str):
        self.file, self.language, self.namespace, self.rows = file, language, "", []

    def add(self, kind: str, line: int, owner: str = "", member: str = "", name: str = "", receiver: str = "", relation: str = "") -> None:
        self.rows.append((self.file, self.language, kind, self.namespace, owner, member, name, receiver, relation, line))


def _closing(text: str, at: int, opening: str = "(", end: str = ")") -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == opening) - (text[i] == end)
        if not depth:
            return i
    return len(text) - 1


def scan_braces(s: Scan, raw: str) -> None:
    """Languages whose bodies stand in braces."""
    text = blank(raw, _MASK)
    line = lambda at: raw.count("\n", 0, at) + 1
    if m := re.search(r"^\s*(?:package|namespace)\s+([\w.\\]+)", text, re.M):
        s.namespace = m[1].replace("\\", ".")
    for m in re.finditer(r"^\s*(?:import|use|using)\s+(?:static\s+)?([\w.\\]+(?:\.[*_])?)(?:\s+as\s+(\w+))?\s*;?[ \t]*$", text, re.M):
        s.add("import", line(m.start()), name=m[1].replace("\\", ".").removesuffix("._"), receiver=m[2] or "")
    for m in re.finditer(r"""^\s*#?\s*(?:import|include|require_once|require)\b[^'"<\n]*['"<]([^'">\n]+)['">]""", raw, re.M):
        s.add("import_file", line(m.start()), name=m[1].lstrip("/"))
    # Bodies of types, the innermost last.
    types = []
    for m in _TYPE.finditer(text):
        if m.end() < len(text) and text[m.end()] == "{":
            owner = m[2]
            types.append((m.end(), _closing(text, m.end(), "{", "}"), owner))
            if m[1] != "extension":
                s.add("type", line(m.start()), name=owner, relation=m[1])
            for relation, base in _bases(m[3], m[1], s.language):
                s.add("base", line(m.start()), owner=owner, name=base.replace("\\", ".").lstrip("."), relation=relation)
    extensions = {m[2] for m in _TYPE.finditer(text) if m[1] == "extension"}
    for start, end, owner in types:
        inner = [(a, b) for a, b, _ in types if start < a and b < end]
        body = text[start + 1 : end]
        for a, b in inner:
            body = body[: a - start - 1] + re.sub(r"[^\n]", " ", body[a - start - 1 : b - start]) + body[b - start :]
        known: dict[str, set[str]] = {}
        for pattern, var, kind in ((_TYPED, 2, 1), (_COLON, 1, 2)):
            for m in pattern.finditer(body):
                known.setdefault(m[var], set()).add(m[kind])
        at = 0
        while m := re.compile(rf"({_NAME})\s*\(|\{{").search(body, at):
            if m[0] == "{":  # a block that is no method, such as an accessor
                at = _closing(body, m.start(), "{", "}") + 1
                continue
            before = body[: m.start()].rstrip()[-1:]
            close = _closing(body, m.end() - 1)
            at = close + 1
            if before in tuple("=.,(@") or m[1] in KEYWORDS:
                continue
            rest = re.compile(r"[^{};=\n]*(\n\s*(?=\{))?").match(body, close + 1)
            stop = rest.end()
            mark = body[stop : stop + 1]
            if mark == "{":
                at = _closing(body, stop, "{", "}") + 1
            elif mark == "=":
                at = next((i for i in (body.find(c, stop) for c in ";\n") if i >= 0), len(body))
            first = line(start + 1 + m.start())
            s.add("extended" if owner in extensions else "method", first, owner=owner, name=m[1])
            if mark in ("{", "="):
                _calls(s, body[stop + 1 : at], owner, m[1], known, first)


def _calls(s: Scan, body: str, owner: str, member: str, known: dict[str, set[str]], line: int) -> None:
    mine = {m.start(1) for m in _THIS.finditer(body)}
    for m in _CALL.finditer(body):
        receiver, name = m[1] or "", m[2]
        if name in KEYWORDS:
            continue
        if m.start(2) in mine or not receiver or receiver in ("this", "self", "$this"):
            of = owner
        elif receiver in ("super", "base", "parent"):
            of = "<super>"
        else:
            bare = receiver.lstrip("$")
            kinds = known.get(bare, {bare} if bare[:1].isupper() else set())
            if len(kinds) != 1:
                continue
            of = next(iter(kinds))
        s.add("call", line + body.count("\n", 0, m.start()), owner=owner, member=member, name=name, receiver=of)


def scan_ruby(s: Scan, raw: str) -> None:
    """Ruby: blocks by their first word, words of bodies as candidates of calls."""
    stack: list[tuple[str, str]] = []
    for n, (line, full) in enumerate(zip(blank(raw, _HASH).split("\n"), raw.split("\n")), 1):
        spaces = [x for k, x in stack if k in ("module", "class")]
        owner = next((x for k, x in reversed(stack) if k in ("module", "class")), "")
        method = next((x for k, x in reversed(stack) if k == "def"), "")
        if m := re.match(r"\s*require(?:_relative)?\s+['\"]([^'\"]+)", full):
            s.add("import_file", n, name=m[1])
        elif m := re.match(r"\s*(module|class)\s+([\w:]+)(?:\s*<\s*([\w:]+))?", line):
            s.namespace = ".".join(spaces)
            s.add("type", n, name=m[2], relation=m[1])
            if m[3]:
                s.add("base", n, owner=m[2], name=m[3].replace("::", "."), relation="inherits")
            stack.append((m[1], m[2]))
        elif m := re.match(r"\s*(?:include|extend|prepend)\s+([\w:]+)", line):
            s.namespace = ".".join(spaces[:-1])
            s.add("base", n, owner=owner, name=m[1].replace("::", "."), relation="mixes_in")
        elif m := re.match(r"\s*def\s+(?:self\.)?(\w+[?!]?)", line):
            s.namespace = ".".join(spaces[:-1])
            s.add("method", n, owner=owner, name=m[1])
            stack.append(("def", m[1]))
        elif re.match(r"\s*end\b", line):
            if stack:
                stack.pop()
        else:
            if method:
                s.namespace = ".".join(spaces[:-1])
                for m in re.finditer(r"(?:([A-Z]\w*)(?:\.new)?\.)?(?<![.\w@:])([a-z_]\w*[?!]?)(?!\s*=[^=])" if "." not in line else r"(?<![\w@:.])(?:([A-Z]\w*)(?:\.new)?\.|self\.)?([a-z_]\w*[?!]?)(?!\s*=[^=])", line):
                    if m[2] not in KEYWORDS and m[2] != "new":
                        s.add("call", n, owner=owner, member=method, name=m[2], receiver=m[1] or owner)
            if re.match(r"\s*(?:if|unless|while|until|case|begin)\b", line) or re.search(r"\bdo\s*(\|[^|]*\|)?\s*$", line):
                stack.append(("block", ""))


def scan_pascal(s: Scan, raw: str) -> None:
    """Pascal: classes in type sections, bodies of qualified procedures."""
    text = blank(raw, _PASCAL)
    line = lambda at: raw.count("\n", 0, at) + 1
    if m := re.search(r"(?i)^\s*(?:unit|program)\s+(\w+)", text, re.M):
        s.namespace = m[1]
    for m in re.finditer(r"(?i)\buses\s+([^;]+);", text):
        for x in m[1].split(","):
            s.add("import", line(m.start()), name=x.split()[0] if x.split() else "")
    for m in re.finditer(r"(?i)(\w+)\s*=\s*class\b(?:\s*\(([^)]*)\))?(.*?)\bend\s*;", text, re.S):
        s.add("type", line(m.start()), name=m[1], relation="class")
        for i, x in enumerate((m[2] or "").split(",")):
            if x.strip():
                s.add("base", line(m.start()), owner=m[1], name=x.strip(), relation="implements" if i else "inherits")
        for f in re.finditer(r"(?i)\b(?:procedure|function)\s+(\w+)", m[3]):
            s.add("method", line(m.start(3) + f.start()), owner=m[1], name=f[1])
    heads = list(re.finditer(r"(?i)^\s*(?:procedure|function)\s+(\w+)\.(\w+)", text, re.M))
    for m, after in zip(heads, [h.start() for h in heads[1:]] + [len(text)]):
        for c in re.finditer(r"(?<![\w.])(?:inherited\s+)?([A-Za-z_]\w*)", text[m.end() : after]):
            if c[1].lower() not in KEYWORDS:
                s.add("call", line(m.end() + c.start()), owner=m[1], member=m[2], name=c[1], receiver="<super>" if c[0].lower().startswith("inherited") else m[1])


def scan_python(s: Scan, raw: str) -> None:
    """Python: imported names, definitions, and calls by a plain name or by a module's alias."""
    tree = ast.parse(raw)
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                s.add("import", n.lineno, name=a.name, receiver=a.asname or a.name, relation="module")
        elif isinstance(n, ast.ImportFrom):
            up = s.file.split("/")[: -n.level] if n.level else []
            module = ".".join([*up, *([n.module] if n.module else [])])
            for a in n.names:
                s.add("import", n.lineno, owner=module, name=a.name, receiver=a.asname or a.name, relation="name")

    def visit(body, owner: str) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                s.add("type", n.lineno, name=n.name, relation="class")
                visit(n.body, n.name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                s.add("method", n.lineno, owner=owner, name=n.name)
                for c in ast.walk(n):
                    if isinstance(c, ast.Call) and isinstance(c.func, ast.Name):
                        s.add("call", c.lineno, owner=owner, member=n.name, name=c.func.id)
                    elif isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute) and isinstance(c.func.value, ast.Name):
                        s.add("call", c.lineno, owner=owner, member=n.name, name=c.func.attr, receiver=c.func.value.id)

    visit(tree.body, "")


def scan_rust(s: Scan, raw: str) -> None:
    """Rust: use declarations, one row a name, and functions and types."""
    text = blank(raw, _MASK)
    line = lambda at: raw.count("\n", 0, at) + 1
    for m in re.finditer(r"\buse\s+([\w:]+?)(?:::\{([^}]*)\})?(?:\s+as\s+(\w+))?\s*;", text):
        for x in m[2].split(",") if m[2] else [""]:
            name, _, alias = x.strip().partition(" as ")
            path = (m[1] + (f"::{name.strip()}" if name and name != "self" else "")).split("::")
            s.add("import", line(m.start()), owner=".".join(p for p in path[:-1] if p != "crate"), name=path[-1], receiver=alias.strip() or m[3] or path[-1], relation="name")
    for m in re.finditer(r"\b(struct|enum|trait|fn)\s+(\w+)", text):
        s.add("method" if m[1] == "fn" else "type", line(m.start()), name=m[2], relation=m[1])
    for m in re.finditer(r"\bfn\s+(\w+)[^{;]*\{", text):
        for c in re.finditer(r"(?<![\w.:])(?:(\w+)::)?([a-z_]\w*)\s*\(", text[m.end() : _closing(text, m.end() - 1, "{", "}")]):
            if c[2] not in KEYWORDS:
                s.add("call", line(m.end() + c.start()), member=m[1], name=c[2], receiver=c[1] or "")


SCANNERS = {"ruby": scan_ruby, "pascal": scan_pascal, "python": scan_python, "rust": scan_rust}


def scan(path: str, content: bytes) -> list[tuple]:
    """The rows of one file; none for other languages, one of kind diagnostic for a file that can't be read."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    if language is None:
        return []
    s = Scan(path, language)
    try:
        SCANNERS.get(language, scan_braces)(s, content.decode("utf-8"))
    except (ValueError, SyntaxError, RecursionError) as e:
        s.rows = []
        s.add("diagnostic", 1, name=f"{type(e).__name__}: {e}"[:512])
    return s.rows


def scopes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The rows of a table of files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            rows = [r for p, c in zip(t["path"], t["content"]) for r in scan(p, bytes(c) if c is not None else b"")]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.selectExpr(f"`{path}` AS path", f"CAST(`{content}` AS BINARY) AS content").mapInPandas(run, SCHEMA)
