"""Facts from engineering and simulation formats in text; what has no reader here is listed as a file only."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from tessera.sources.documents import Facts, parse_json


class _Named:
    """Nodes of a file by key, made on first sight."""

    def __init__(self, f: Facts, kind: str):
        self.f, self.kind, self.seen = f, kind, {}

    def __call__(self, key: str, parent: str = "", label: str = "", line: int = 1, kind: str = "") -> str:
        if key not in self.seen:
            self.seen[key] = self.f.child(parent or self.f.file, key, label or key, kind or self.kind, line)
        return self.seen[key]


def kicad(f: Facts, text: str) -> None:
    """SRC48: footprints, symbols, sheets and nets of nested lists; a pad's net connects its owner."""
    made = _Named(f, "net")
    owners: list[str | None] = []
    line = 1
    for m in re.finditer(r'\(\s*([\w.]+)(?:\s+(\d+))?(?:\s+("(?:\\.|[^"\\])*"|[^\s()"]+))?|\)|"(?:\\.|[^"\\])*"|\n', text):
        if m[0] == "\n":
            line += 1
            continue
        line += m[0].count("\n")
        if m[0] == ")":
            if owners:
                owners.pop()
            continue
        if m[1] is None:
            continue
        owner = next((o for o in reversed(owners) if o), None)
        name, opened = (m[3] or "").strip('"'), None
        if m[1] in ("footprint", "module", "symbol", "sheet") and name:
            opened = f.child(owner or f.file, f"{m[1]}{line}.{m.start()}", name, m[1], line)
        elif m[1] == "net" and name:
            net = made(f"net:{name}", label=name, line=line)
            if owner:
                f.edge(owner, net, "connects", line)
        owners.append(opened)


def modelica(f: Facts, text: str) -> None:
    """SRC48: classes with their nesting, what they extend, and connected parts."""
    made = _Named(f, "class")
    stack: list[str] = []
    for n, line in enumerate(re.sub(r"//[^\n]*", "", text).splitlines(), 1):
        owner = made(".".join(stack)) if stack else f.file
        if m := re.match(r"\s*(?:(?:partial|encapsulated|final|replaceable)\s+)*(model|package|block|connector|record|function|class|type)\s+(\w+)", line):
            stack.append(m[2])
            made(".".join(stack), owner, m[2], n, m[1])
            if ";" in line and not re.search(r"\bend\b", line):
                stack.pop()
        elif m := re.match(r"\s*extends\s+([\w.]+)", line):
            f.edge(owner, f"name:{m[1]}", "extends", n)
        elif m := re.match(r"\s*connect\s*\(\s*([\w.\[\]]+)\s*,\s*([\w.\[\]]+)\s*\)", line):
            scope = ".".join(stack)
            f.edge(made(f"{scope}:{m[1]}", owner, m[1], n, "port"), made(f"{scope}:{m[2]}", owner, m[2], n, "port"), "connects", n)
        elif stack and re.match(rf"\s*end\s+{stack[-1]}\s*;", line):
            stack.pop()


def ifc(f: Facts, text: str) -> None:
    """SRC48: entities of a STEP file and the entities that they refer to, also ones that come later."""
    rows = []
    for m in re.finditer(r"#(\d+)\s*=\s*(\w+)\s*\(((?:'(?:''|[^'])*'|[^';])*)\)\s*;", text):
        texts = re.findall(r"'((?:''|[^'])*)'", m[3])
        line = text.count("\n", 0, m.start()) + 1 if len(rows) == 0 else rows[-1][2] + text.count("\n", rows[-1][3], m.start())
        at = f.child(f.file, f"#{m[1]}", (texts[1] if len(texts) > 1 else "") or m[2], m[2].lower(), line)
        rows.append((at, re.sub(r"'(?:''|[^'])*'", "", m[3]), line, m.start()))
    known = {r[0] for r in rows}
    for at, arguments, line, _ in rows:
        for ref in dict.fromkeys(re.findall(r"#(\d+)", arguments)):
            if f"{f.file}##{ref}" in known:
                f.edge(at, f"{f.file}##{ref}", "references", line)


def dxf(f: Facts, text: str) -> None:
    """SRC48: layers with their entities, from pairs of a group code and a value."""
    made = _Named(f, "layer")
    lines = text.splitlines()
    inside, kind, start = False, "", 0
    for n in range(0, len(lines) - 1, 2):
        code, value = lines[n].strip(), lines[n + 1].strip()
        if code == "0":
            kind, start = value, n + 1
            inside = inside and value != "ENDSEC"
        elif code == "2" and kind == "SECTION":
            inside = value == "ENTITIES"
        elif code == "8" and inside:
            f.child(made(f"layer:{value}", label=value, line=n + 1), f"entity{start}", kind, "entity", start)


def turtle(f: Facts, text: str) -> None:
    """SRC48: triples between names; literals are left out, a type is a reference like others."""
    made = _Named(f, "resource")
    subject = predicate = None
    for m in re.finditer(r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"(?:@[\w-]+|\^\^\S+)?|#[^\n]*|@\w+[^\n]*\.[ \t]*(?=\n|$)|<[^>\s]*>|[;,.](?=\s|$)|[^\s;,"<>\[\]()]*[^\s;,."<>\[\]()]', text):
        t = m[0]
        if t[0] in "#@":
            continue
        if t == ".":
            subject = predicate = None
        elif t == ";":
            predicate = None
        elif t == ",":
            continue
        elif subject is None:
            subject = made(t)
        elif predicate is None:
            predicate = t
        elif t[0] != '"' and not re.match(r"[-+]?[\d.]+$|true$|false$", t):
            f.edge(subject, made(t), "references", text.count("\n", 0, m.start()) + 1)


def energyplus(f: Facts, text: str) -> None:
    """SRC48: objects with their first field as name; a field that names another object refers to it."""
    objects = []
    clean = re.sub(r"![^\n]*", "", text)
    line = 1
    for part in clean.split(";"):
        fields = [x.strip() for x in part.split(",")]
        if len(fields) > 1 and fields[0]:
            lead = part[: len(part) - len(part.lstrip())].count("\n")
            at = f.child(f.file, f"object{len(objects)}", fields[1] or fields[0], fields[0].lower(), line + lead)
            objects.append((at, fields, line + lead))
        line += part.count("\n")
    names: dict[str, str] = {}
    for at, fields, _ in objects:
        names.setdefault(fields[1].lower(), at)
    for at, fields, n in objects:
        for x in dict.fromkeys(v.lower() for v in fields[2:] if v):
            if x in names and names[x] != at:
                f.edge(at, names[x], "references", n)


def robot(f: Facts, text: str) -> None:
    """SRC49: links, joints and bodies of URDF, SDF and MJCF; a joint refers to the links that it joins."""
    made = _Named(f, "link")
    kinds = ("robot", "model", "world", "link", "joint", "body", "geom", "sensor", "material", "mesh")

    def walk(e: ET.Element, parent: str) -> None:
        tag = e.tag.rsplit("}", 1)[-1]
        at = parent
        if tag in kinds and e.get("name"):
            at = made(f"{tag}:{e.get('name')}", parent, e.get("name"), kind=tag)
        if tag == "joint":
            for side in ("parent", "child"):
                found = next((c for c in e if c.tag.rsplit("}", 1)[-1] == side), None)
                link = (found.get("link") or (found.text or "").strip()) if found is not None else ""
                if link:
                    f.edge(at, f"{f.file}#link:{link}", "references")
        for c in e:
            walk(c, at)

    walk(ET.fromstring(text), f.file)


def gltf(f: Facts, text: str) -> None:
    """SRC49: scenes, nodes, meshes, materials and cameras with what they use."""
    doc = json.loads(text)
    if not isinstance(doc, dict):
        raise ValueError("not an object")
    many = lambda x: x if isinstance(x, list) else []
    lists = {k: [x if isinstance(x, dict) else {} for x in many(doc.get(k))] for k in ("scenes", "nodes", "meshes", "materials", "cameras")}
    ids = {(k, i): f.child(f.file, f"{k}[{i}]", str(x.get("name") or f"{k}[{i}]"), k, 1) for k, xs in lists.items() for i, x in enumerate(xs)}

    def link(at: str, kind: str, index, relation: str) -> None:
        if isinstance(index, int) and (kind, index) in ids:
            f.edge(at, ids[kind, index], relation)

    for (k, i), at in ids.items():
        x = lists[k][i]
        for c in many(x.get("nodes" if k == "scenes" else "children")):
            link(at, "nodes", c, "contains")
        link(at, "meshes", x.get("mesh"), "uses_mesh")
        link(at, "cameras", x.get("camera"), "uses_camera")
        for p in many(x.get("primitives")):
            link(at, "materials", p.get("material") if isinstance(p, dict) else None, "uses_material")


def usd(f: Facts, text: str) -> None:
    """SRC49: prims with their nesting, and the assets that they refer to."""
    stack: list[tuple[int, str]] = []
    depth, waiting = 0, None
    for n, line in enumerate(text.splitlines(), 1):
        owner = stack[-1][1] if stack else f.file
        if m := re.match(r'\s*(?:def|over|class)\s+(?:(\w+)\s+)?"([^"]+)"', line):
            path = f"{owner.split('#', 1)[1] if stack else ''}/{m[2]}"
            waiting = f.child(owner, path, m[2], m[1] or "prim", n)
        for asset in re.findall(r"@([^@]+)@", line):
            f.edge(waiting or owner, f"asset:{asset}", "references", n)
        for c in re.sub(r'"[^"]*"|@[^@]*@', "", line):
            if c == "{":
                depth += 1
                if waiting:
                    stack.append((depth, waiting))
                    waiting = None
            elif c == "}":
                if stack and stack[-1][0] == depth:
                    stack.pop()
                depth -= 1


def json5(f: Facts, text: str) -> None:
    """SRC19: as JSON where comments and commas are all that differs; else keys and their nesting without values."""
    try:
        return parse_json(f, text)
    except ValueError:
        pass
    stack: list[tuple[str, str]] = []
    key, line, n = None, 1, 0
    tokens = [m[0] for m in re.finditer(r'"(?:\\[\s\S]|[^"\\])*"|\'(?:\\[\s\S]|[^\'\\])*\'|//[^\n]*|/\*[\s\S]*?\*/|[{}\[\]:,]|\n|[^\s{}\[\]:,"\']+', text)]
    for i, t in enumerate(tokens):
        if t == "\n" or t[:2] in ("//", "/*"):
            line += t.count("\n")
        elif t in "{[":
            at = f.child(stack[-1][1] if stack else f.file, f"$.{n}", key or t, "object_key" if key else "element", line) if stack else f.file
            stack.append((t, at))
            n, key = n + 1, None
        elif t in "}]":
            if not stack or stack.pop()[0] != ("{" if t == "}" else "["):
                raise ValueError(f"unbalanced {t} in line {line}")
            key = None
        elif t == ",":
            key = None
        elif t != ":" and stack and stack[-1][0] == "{" and key is None:
            key = t.strip("\"'")
            follow = next((x for x in tokens[i + 2 :] if x != "\n" and x[:2] not in ("//", "/*")), "")
            if follow not in ("{", "["):
                f.child(stack[-1][1], f"$.{n}", key, "scalar", line)
                n += 1
    if stack:
        raise ValueError("unbalanced brackets")


#: Readers by extension.
ENGINEERING = {
    "kicad_sch": kicad, "kicad_pcb": kicad, "kicad_mod": kicad, "kicad_sym": kicad, "mo": modelica, "ifc": ifc, "dxf": dxf, "ttl": turtle, "idf": energyplus,
    "urdf": robot, "sdf": robot, "mjcf": robot, "gltf": gltf, "usda": usd, "json5": json5,
}
