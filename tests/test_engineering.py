"""Engineering and simulation formats on tiny files."""

import pytest

from tessera.sources.documents import extract

FILES = {
    "a.kicad_pcb": ('(kicad_pcb (net 1 "GND")\n (footprint "R_0603" (pad "1" smd (net 1 "GND"))))', {("R_0603", "connects", "GND")}),
    "b.mo": ("package P\n  model A\n    extends Base;\n    connect(x.p, y.n);\n  end A;\nend P;", {("P", "contains", "A"), ("A", "extends", "name:Base"), ("x.p", "connects", "y.n")}),
    "c.ifc": ("#1=IFCWALL('g','Wall #2');\n#3=IFCREL('h','Rel',#1,#9);", {("Rel", "references", "Wall #2")}),
    "d.dxf": ("0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nWalls\n0\nENDSEC\n0\nEOF", {("Walls", "contains", "LINE")}),
    "e.ttl": ('@prefix b: <http://x.y/#> .\nb:ahu a b:AHU ;\n  b:feeds b:vav1, b:vav2 ;\n  b:label "vav3" .', {("b:ahu", "references", "b:vav1"), ("b:ahu", "references", "b:vav2"), ("b:ahu", "references", "b:AHU")}),
    "f.idf": ("Zone, Hall; ! a, b;\nWall, W1,\n hall;", {("W1", "references", "Hall")}),
    "g.urdf": ('<robot name="r"><link name="a"/><link name="b"/><joint name="j"><parent link="a"/><child link="b"/></joint></robot>', {("j", "references", "a"), ("j", "references", "b"), ("r", "contains", "j")}),
    "h.gltf": ('{"scenes":[{"nodes":[0]}],"nodes":[{"name":"n","mesh":0}],"meshes":[{"name":"m"}]}', {("scenes[0]", "contains", "n"), ("n", "uses_mesh", "m")}),
    "i.usda": ('#usda 1.0\ndef Xform "World"\n{\n  def Mesh "Box" (\n    references = @box.usd@\n  )\n  {\n  }\n}', {("World", "contains", "Box"), ("Box", "references", "asset:box.usd")}),
    "j.json5": ("{a: {'b': 0x1f, // c\n d: [1, {e: +1}]}}", {("a", "contains", "b"), ("a", "contains", "d"), ("{", "contains", "e")}),
}


@pytest.mark.parametrize("name", sorted(FILES))
def test_facts(name):
    text, want = FILES[name]
    rows = extract(name, text.encode())
    label = {r[1]: r[2] for r in rows if r[0] == "node"}
    got = {(label.get(r[1], r[1]), r[3], label.get(r[4], r[4])) for r in rows if r[0] == "edge"}
    assert want <= got and not [r for r in rows if r[0] == "diagnostic"]
    if name == "e.ttl":
        assert not any("vav3" in str(e) for e in got)


@pytest.mark.parametrize("name", sorted(FILES))
@pytest.mark.parametrize("text", ["", "(", "}{", "#1=(((", "{a:", "0\n", '"""', "<x", "]"])
def test_bad_files_stop_nothing(name, text):
    assert extract(name, text.encode())[0][0] == "node"
