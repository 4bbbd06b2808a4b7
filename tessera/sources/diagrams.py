"""Facts from diagrams in text: Mermaid, PlantUML, D2, DBML and Structurizr."""

from __future__ import annotations

import re

from tessera.sources.documents import Facts

_NAME = r'(?:"[^"]+"|[A-Za-z_][\w.-]*)'


def _linker(f: Facts):
    seen: dict[str, str] = {}

    def node(name: str, label: str | None = None) -> str:
        key = name.strip('"')
        if key not in seen:
            seen[key] = f.child(f.file, key, (label or key).strip('"'), "diagram_node")
        return seen[key]

    return node


def mermaid(f: Facts, text: str) -> None:
    """SRC47: nodes with labels and the links of flow charts, classes and sequences."""
    node = _linker(f)
    shape = r"(?:[\[({>|]+\"?([^\])}|\"]*)\"?[\])}|]+)?"
    for n, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"%%.*", "", line).strip()
        if not line or re.match(r"(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram|erDiagram|subgraph|end|direction)\b", line):
            continue
        parts = re.split(r"\s*(?:-->>|->>|-->|---|-\.->|==>|<\|--|\*--|o--|\.\.>|\|\|--o\{)(?:\|[^|]*\|)?\s*", re.sub(r":[^:].*$", "", line))
        ids = []
        for p in parts:
            if m := re.match(rf"({_NAME}){shape}$", p.strip()):
                ids.append(node(m[1], m[2]))
        for a, b in zip(ids, ids[1:]):
            f.edge(a, b, "flows_to", n)


def plantuml(f: Facts, text: str) -> None:
    """SRC47: declared elements and arrows."""
    node = _linker(f)
    for n, line in enumerate(text.splitlines(), 1):
        if m := re.match(rf"\s*(?:abstract\s+)?(?:class|interface|enum|component|actor|participant|database|node|package|rectangle|usecase)\s+({_NAME})(?:\s+as\s+({_NAME}))?", line):
            node(m[2] or m[1], m[1])
        elif m := re.match(rf"\s*({_NAME})\s*(?:\"[^\"]*\"\s*)?(<?[-.|*o<>]+(?:\w+[-.]+)?[-.|*o<>]*)\s*(?:\"[^\"]*\"\s*)?({_NAME})", line):
            a, b = node(m[1]), node(m[3])
            back = m[2].startswith("<") and not m[2].endswith(">")
            f.edge(*((b, a) if back else (a, b)), "inherits" if "|" in m[2] else "flows_to", n)


def d2(f: Facts, text: str) -> None:
    """SRC47: keys with labels, and connections."""
    node = _linker(f)
    for n, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"#.*", "", line).strip().rstrip("{").strip()
        parts = re.split(r"\s*(<->|->|<-|--)\s*", re.sub(r":.*", "", line))
        sides = parts[::2]
        if len(sides) > 1 and all(sides):
            ids = [node(x) for x in sides]
            for a, arrow, b in zip(ids, parts[1::2], ids[1:]):
                if arrow != "<-":
                    f.edge(a, b, "flows_to", n)
                if arrow in ("<-", "<->"):
                    f.edge(b, a, "flows_to", n)
        elif m := re.match(rf"({_NAME})\s*:\s*(.+)", line):
            node(m[1], m[2])


def dbml(f: Facts, text: str) -> None:
    """SRC47: tables with columns, and references."""
    table = ""
    for n, line in enumerate(text.splitlines(), 1):
        if m := re.match(r'\s*Table\s+"?([\w.]+)', line, re.I):
            table = m[1]
            f.child(f.file, table, table, "sql_table", n)
        elif re.match(r"\s*}", line):
            table = ""
        elif table and (m := re.match(r'\s*"?(\w+)"?\s+(\w+)', line)):
            f.child(f"{f.file}#{table}", f"{table}.{m[1]}", m[1], "column", n)
        for m in re.finditer(r"(?:(\w+)\.\w+\s*)?[<>-]\s*(\w+)\.\w+", line):
            if m[1] or table:
                f.edge(f"{f.file}#{m[1] or table}", f"{f.file}#{m[2]}", "references", n)


def structurizr(f: Facts, text: str) -> None:
    """SRC47: people, systems, containers and components, and their relationships."""
    node = _linker(f)
    for n, line in enumerate(text.splitlines(), 1):
        if m := re.match(rf'\s*({_NAME})\s*=\s*(person|softwareSystem|container|component)\s+"([^"]*)"', line, re.I):
            node(m[1], m[3])
        elif m := re.match(rf"\s*({_NAME})\s*->\s*({_NAME})", line):
            f.edge(node(m[1]), node(m[2]), "uses", n)


DIAGRAMS = {"mmd": mermaid, "mermaid": mermaid, "puml": plantuml, "plantuml": plantuml, "d2": d2, "dbml": dbml, "dsl": structurizr}
