"""Types and calls bind by the rules of their language, and never across languages."""

import pytest

from tessera.operators import languages as L
from tessera.sources.scopes import scan, scopes

FILES = {
    "j/api/Task.java": "package shop.api;\npublic interface Task { String run(String v); }",
    "j/api/Base.java": "package shop.api;\npublic abstract class Base implements Task {\n  protected String clean(String v) { return v; }\n}",
    "j/other/Base.java": "package shop.other;\npublic class Base { String clean(String v) { return v; } }",
    "j/app/Job.java": "package shop.app;\nimport shop.api.Base;\nimport shop.api.Task;\n// class Ghost extends Base {}\nclass Job extends Base {\n  private final Task task;\n  Job(Task task) { this.task = task; }\n  String go(String v) { return task.run(clean(v)); }\n}",
    "j/app/Lost.java": "package shop.app;\nclass Lost extends Unknown { void go() { missing(); } }",
    "k/Kin.kt": "package kin\nopen class Elder {\n    open fun tell(v: String): String = v.trim()\n}\nclass Younger : Elder() {\n    override fun tell(v: String): String = super.tell(v)\n}",
    "cs/Svc.cs": "namespace Acme.Core;\npublic interface IJob { string Do(string v); }\npublic class Svc : IJob { public virtual string Do(string v) => v.Trim(); }",
    "cs/Run.cs": "namespace Acme.Core;\npublic class Run : Svc {\n  private readonly IJob _job;\n  public Run(IJob job) { _job = job; }\n  public string Go(string v) => _job.Do(Do(v));\n}",
    "php/A.php": "<?php\nnamespace App;\ninterface Job { public function act(string $v): string; }\nclass Svc implements Job { public function act(string $v): string { return trim($v); } }",
    "php/B.php": "<?php\nnamespace App;\nclass Child extends SVC { public function go(string $v): string { return $this->ACT($v); } }",
    "rb/w.rb": "module Mill\n  module Audit\n    def audit(v)\n      v\n    end\n  end\n  class Worker\n    include Audit\n    def work(v)\n      audit(v)\n    end\n  end\nend\n",
    "rb/r.rb": "require_relative 'w'\nmodule Mill\n  class Runner < Worker\n    def go(v)\n      work(v) if v\n    end\n  end\nend\n",
    "s/W.swift": "protocol Doer {\n  func act(_ v: String) -> String\n}\nclass Svc: Doer {\n  func act(_ v: String) -> String {\n    v\n  }\n}",
    "s/X.swift": "extension Svc {\n  func twice(_ v: String) -> String {\n    act(v)\n  }\n}\nclass Use {\n  let svc: Svc\n  func go() {\n    svc.twice(x)\n  }\n}",
    "p/W.pas": "unit W;\ninterface\ntype\n  TW = class\n    procedure Work; virtual;\n  end;\nimplementation\nprocedure TW.Work;\nbegin\nend;\nend.",
    "p/R.pas": "unit R;\ninterface\nuses w;\ntype\n  TR = class(tw)\n    procedure Go;\n  end;\nimplementation\nprocedure TR.Go;\nbegin\n  WORK; { Ghost }\nend;\nend.",
    "c/w.h": "class Mach {\n public:\n  int turn(int v);\n};",
    "c/r.cpp": '#include "w.h"\nstruct Shop : public Mach {\n  int go(Mach& m) { return m.turn(1); }\n};',
    "d/w.dart": "class Svc {\n  String act(String v) => v.trim();\n}",
    "d/r.dart": "import 'w.dart';\nclass Runner extends Svc {\n  String go(String v) => act(v);\n}",
    "d/alone.dart": "class Far extends Svc {}",
    "py/pkg/tool.py": "def helper():\n    pass\n",
    "py/pkg/use.py": "from pkg.tool import helper as h\nfrom . import tool\nimport pkg.tool as t\n\ndef one():\n    h()\n\ndef two():\n    t.helper()\n\ndef three():\n    other()\n",
    "rs/src/mill/gear.rs": "pub fn spin() {}\n",
    "rs/src/lib.rs": "use crate::mill::gear::spin;\nuse crate::mill::gear;\nfn a() { spin(); }\nfn b() { gear::spin(); }\n",
    "bad.py": "def (:",
    "n.txt": "class No {}",
}
WANTED = {
    ("j/api/Base.java#Base", "j/api/Task.java#Task", "implements"), ("j/app/Job.java#Job", "j/api/Base.java#Base", "inherits"),
    ("j/app/Job.java#Job.go", "j/api/Task.java#Task.run", "calls"), ("j/app/Job.java#Job.go", "j/api/Base.java#Base.clean", "calls"),
    ("k/Kin.kt#Younger", "k/Kin.kt#Elder", "inherits"), ("k/Kin.kt#Younger.tell", "k/Kin.kt#Elder.tell", "calls"),
    ("cs/Svc.cs#Svc", "cs/Svc.cs#IJob", "implements"), ("cs/Run.cs#Run", "cs/Svc.cs#Svc", "inherits"),
    ("cs/Run.cs#Run.Go", "cs/Svc.cs#IJob.Do", "calls"), ("cs/Run.cs#Run.Go", "cs/Svc.cs#Svc.Do", "calls"),
    ("php/A.php#Svc", "php/A.php#Job", "implements"), ("php/B.php#Child", "php/A.php#Svc", "inherits"), ("php/B.php#Child.go", "php/A.php#Svc.act", "calls"),
    ("rb/w.rb#Worker", "rb/w.rb#Audit", "mixes_in"), ("rb/r.rb#Runner", "rb/w.rb#Worker", "inherits"), ("rb/w.rb#Worker.work", "rb/w.rb#Audit.audit", "calls"), ("rb/r.rb#Runner.go", "rb/w.rb#Worker.work", "calls"),
    ("s/W.swift#Svc", "s/W.swift#Doer", "inherits"), ("s/X.swift#Svc.twice", "s/W.swift#Svc.act", "calls"), ("s/X.swift#Use.go", "s/X.swift#Svc.twice", "calls"),
    ("p/R.pas#TR", "p/W.pas#TW", "inherits"), ("p/R.pas#TR.Go", "p/W.pas#TW.Work", "calls"),
    ("c/r.cpp#Shop", "c/w.h#Mach", "inherits"), ("c/r.cpp#Shop.go", "c/w.h#Mach.turn", "calls"),
    ("d/r.dart#Runner", "d/w.dart#Svc", "inherits"), ("d/r.dart#Runner.go", "d/w.dart#Svc.act", "calls"),
    ("py/pkg/use.py#one", "py/pkg/tool.py#helper", "calls"), ("py/pkg/use.py#two", "py/pkg/tool.py#helper", "calls"),
    ("rs/src/lib.rs#a", "rs/src/mill/gear.rs#spin", "calls"), ("rs/src/lib.rs#b", "rs/src/mill/gear.rs#spin", "calls"),
}


def test_languages(spark):
    files = spark.createDataFrame([(p, t.encode()) for p, t in FILES.items()], "path string, content binary")
    rows = scopes(files)
    got = {tuple(r) for r in L.resolve(rows).collect()}
    assert got == WANTED
    assert [r.source_file for r in rows.where("kind = 'diagnostic'").collect()] == ["bad.py"]


def test_a_name_that_many_files_declare_binds_nowhere(spark):
    """Types are counted before the join: 300 uses of a name with 300 types give no pair of both."""
    files = [(f"m{i}.swift", b"class Same {}\nclass Child%d: Same {}" % i) for i in range(300)] + [("own.swift", b"class Far: Same {}")]
    rows = scopes(spark.createDataFrame(files, "path string, content binary"))
    uses = rows.where("kind = 'base'")
    got = {(r.file, r.target) for r in L.bind_types(uses, rows).collect()}
    assert got == {(f"m{i}.swift", f"m{i}.swift#Same") for i in range(300)}


def test_cycles_of_bases_end(spark):
    links = spark.createDataFrame([("a", "b", "inherits"), ("b", "a", "inherits"), ("b", "c", "inherits")], "src string, tgt string, relation string")
    assert {tuple(r) for r in L.ancestors(links).collect()} == {("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("a", "c", 2)}


@pytest.mark.parametrize("name", ["x.java", "x.rb", "x.pas", "x.rs", "x.py"])
def test_empty_and_odd_texts(name):
    assert scan(name, b"") == []
    scan(name, b"class A {{{ end end ((( begin")
    assert [r[2] for r in scan(name, b"\xff\xfe")] == ["diagnostic"]
