"""Golden sets for parsing and name resolution."""

import random

from codelore.operators import chunking, othercode, pycode
from codelore.plans import code


def edges(spark, *kinds):
    return {(r.kind, r.source, r.target, r.via) for r in code._edges(spark, *kinds).collect()}


def test_imports(spark):
    got = {(s, t) for _, s, t, _ in edges(spark, "IMPORTS")}
    assert got == {
        ("shop/__init__.py", "shop/models.py"), ("shop/models.py", "shop/base.py"), ("shop/service.py", "shop/models.py"),
        ("shop/service.py", "shop/__init__.py"), ("shop/service.py", "shop/base.py"), ("tests/test_service.py", "shop/service.py"),
    }


def test_inheritance_and_calls(spark):
    assert {(k, s, t) for k, s, t, _ in edges(spark, "INHERITS", "IMPLEMENTS")} == {
        ("INHERITS", "shop/models.py::Order", "shop/base.py::Base"),
        ("IMPLEMENTS", "shop/models.py::Order", "shop/base.py::Saves"),
    }
    calls = edges(spark, "CALLS")
    assert ("CALLS", "shop/models.py::make", "shop/models.py::Order", "constructor") in calls
    assert ("CALLS", "shop/service.py::run", "shop/models.py::Order.save", "local-instance") in calls
    assert ("CALLS", "shop/models.py::Order.save", "shop/base.py::Base.close", "self") in calls
    assert ("CALLS", "shop/models.py::Order.save", "shop/base.py::Base.load", "super") in calls
    assert ("CALLS", "shop/service.py::run", "shop/models.py::make", "name") in calls
    assert ("CALLS", "tests/test_service.py::test_run", "shop/service.py::run", "name") in calls
    assert ("CALLS", "shop/service.py::run", "shop/base.py::Base", "constructor") in calls


def test_order_of_files_does_not_matter():
    files = [{"repository": r, "path": p, "symbols": pycode.analyse_source(c)[0], "imports": pycode.analyse_source(c)[1]} for r, p, c in code.FILES]
    one = sorted(pycode.Repository([dict(f) for f in files]).edges())
    random.Random(1).shuffle(files)
    assert sorted(pycode.Repository([dict(f) for f in files]).edges()) == one


def test_opaque_base_blocks_lookup():
    source = "from other import Base\n\n\nclass A(Base):\n    def f(self):\n        return self.g()\n\n\nclass B(A):\n    def g(self):\n        return self.f()\n"
    files = [{"repository": "r", "path": "m.py", "symbols": pycode.analyse_source(source)[0], "imports": pycode.analyse_source(source)[1]}]
    calls = {(s, t) for k, s, t, _, _ in pycode.Repository(files).edges() if k == "CALLS"}
    assert calls == {("m.py::B.g", "m.py::A.f")}


def calls(**sources):
    files = [{"repository": "r", "path": p.replace("__", "/") + ".py" if p != "init" else "pkg/__init__.py", **pycode.analyse_source(c)._asdict()} for p, c in sources.items()]
    return {(s, t, v) for k, s, t, v, _ in pycode.Repository(files).edges() if k == "CALLS"}


HELP = "class Repo:\n    def save(self): ...\n\n\ndef save(): ...\n\n\ndef _hidden(): ...\n"


def test_stated_types_resolve_and_hidden_names_do_not():
    source = (
        "from m import Repo, save\n\n\nclass S:\n    backup: Repo\n\n    def __init__(self):\n        self.repo = Repo()\n        self.any = pick()\n\n"
        "    def run(this):\n        this.repo.save()\n        this.backup.save()\n        this.any.save()\n\n    @classmethod\n    def make(cls):\n        cls.run()\n\n"
        "\ndef typed(x: 'Repo | None', y, save):\n    x.save()\n    y.save()\n    save()\n\n\ndef twice(x: Repo):\n    x = other()\n    x.save()\n"
    )
    got = calls(m=HELP, s=source)
    assert got == {("s.py::S.__init__", "m.py::Repo", "constructor"), ("s.py::S.run", "m.py::Repo.save", "self"), ("s.py::S.make", "s.py::S.run", "self"), ("s.py::typed", "m.py::Repo.save", "local-instance")}


def test_star_imports_and_ambiguous_names():
    assert calls(m=HELP, s="from m import *\n\n\ndef f():\n    save()\n    _hidden()\n") == {("s.py::f", "m.py::save", "name")}
    assert calls(m="__all__ = ['Repo']\n" + HELP, s="from m import *\n\n\ndef f():\n    save()\n    Repo()\n") == {("s.py::f", "m.py::Repo", "constructor")}
    assert calls(m="__all__ = list(x)\n" + HELP, s="from m import *\n\n\ndef f():\n    save()\n") == set()
    assert calls(m=HELP, s="from m import save\nsave = wrap(save)\n\n\ndef f():\n    save()\n") == set()
    assert calls(m=HELP, init="", pkg__sub="def go(): ...\n", s="import pkg\n\n\ndef f():\n    pkg.sub.go()\n") == {("s.py::f", "pkg/sub.py::go", "attribute")}
    assert calls(a="from b import x\n\n\ndef f():\n    x()\n", b="from a import x\n") == set()


def test_class_order():
    def order(source, name):
        return pycode.Repository([{"repository": "r", "path": "m.py", **pycode.analyse_source(source)._asdict()}]).mro(("m.py", name))

    diamond = "from abc import ABC\nfrom x import E\nclass A(ABC): ...\nclass B(A): ...\nclass C(A, E): ...\nclass D(B, C): ...\n"
    assert [n for _, n in order(diamond, "D")] == ["D", "B", "C", "A", "x.E"]
    assert order("class A(B): ...\nclass B(A): ...\n", "A") is None
    assert order("class A: ...\nclass B(A): ...\nclass C(A, B): ...\n", "C") is None
    assert [n for _, n in order("from x import P, Q\nclass A(P, Q, object): ...\n", "A")] == ["A", "x.P", "x.Q"]
    assert [n for _, n in order("from mine import Protocol\nclass A(Protocol): ...\n", "A")] == ["A", "mine.Protocol"]


def test_units_cover_and_split():
    source = "import os\nX = 1\n\n# about f\n@deco\ndef f():\n    pass\n\nclass C:\n    a = 1\n" + "".join("    def m%d(self):\n        return '%s'\n" % (i, "x" * 60) for i in range(40))
    units = chunking.syntax_units(source)
    assert units[0] == ("module", "", 1, 2) and units[1] == ("function", "f", 4, 7)
    assert [u[1] for u in units if u[0] == "method"] == [f"C.m{i}" for i in range(40)]
    assert chunking.syntax_units("def (") is None
    sizes = [51] * 120
    pieces = chunking.split_oversize(sizes)
    assert {i for a, b in pieces for i in range(a, b + 1)} == set(range(120))
    assert all(b > a for a, b in pieces) and all(c == b - 1 for (_, b), (c, _) in zip(pieces, pieces[1:]))
    assert pieces[0] == (0, 39)  # the line that reaches the limit ends the piece
    assert chunking.split_oversize([9000]) == [(0, 0)] and chunking.split_oversize([1500, 600]) == [(0, 1)]


def test_class_comments_belong_to_their_method():
    body = "".join(f"    # says {i}\n    @deco\n    def m{i}(self):\n        return '{'x' * 900}'\n\n" for i in range(3))
    source = f"class C:\n    a = 1\n{body}    b = 2\n"
    units = chunking.syntax_units(source)
    assert [(k, n, s, e) for k, n, s, e in units] == [("class", "C", 1, 3), ("method", "C.m0", 4, 6), ("method", "C.m1", 8, 11), ("method", "C.m2", 13, 16), ("class", "C", 17, 18)]


def test_chunk_files(spark):
    code = "def first():\n    return 'a long enough body'\n"
    rows = [("r", "python", "a.py", "a.py", ".py", "1", code), ("r", "python", "b.py", "b.py", ".py", "2", "def (: this does not parse at all"), ("r", "go", "c.go", "c.go", ".go", "3", "package main // " + "x" * 3000), ("s", None, "a.py", "a.py", "", "4", "some text without a language"), ("r", "python", "e.py", "e.py", ".py", "5", "")]
    files = spark.createDataFrame(rows, "repository string, language string, file_name string, relative_path string, extension string, file_hash string, content string")
    got = {(r.repository, r.relative_path, r.chunk_index): (r.chunk_type, r.symbol, r.start_line, r.end_line) for r in chunking.chunk_files(files).collect()}
    assert got == {("r", "a.py", 0): ("function", "first", 1, 2), ("r", "b.py", 0): ("block", "", 1, 1), ("r", "c.go", 0): ("block", "", 1, 1), ("r", "c.go", 1): ("block", "", 1, 1), ("s", "a.py", 0): ("block", "", 1, 1)}


OTHER = {
    "javascript": ("import React from 'react';\nimport './side.css';\nconst fs = require('fs')\nexport default class App extends React.Component {}\nexport const go = async () => 1\nfunction stop() {}\n", {"react": 1, "./side.css": 1, "fs": 3}, {("class", "App", 3), ("function", "go", 4), ("function", "stop", 5)}),
    "java": ("package a;\nimport java.util.List;\npublic final class Box {\n}\n", {"java.util.List": 1}, {("class", "Box", 2)}),
    "go": ('package m\nimport "fmt"\nfunc (s *S) Run() {\n}\n', {"fmt": 1}, {("function", "Run", 2)}),
    "rust": ("use std::io;\npub fn run() {}\nstruct S;\n", {"std::io": 1}, {("function", "run", 1), ("function", "S", 2)}),
    "c": ("#include <stdio.h>\nint main() {}\n", {"stdio.h": 1}, set()),
    "css": ("a { }", {}, set()),
}


def test_other_languages(spark):
    rows = [("r", f"f.{language}", language, source) for language, (source, _, _) in OTHER.items()] + [("r", "null", "go", None)]
    found = {r.path: r for r in othercode.analyse(spark.createDataFrame(rows, "repository string, path string, language string, content string")).collect()}
    for language, (source, imports, symbols) in OTHER.items():
        r = found[f"f.{language}"]
        assert {i.module for i in r.imports} == set(imports), language
        assert {(s.kind, s.name) for s in r.symbols} == {(k, n) for k, n, _ in symbols}, language
        assert r.line_count == source.count("\n") + 1
    react = next(s for s in found["f.javascript"].symbols if s.name == "App")
    assert react.bases == ["React.Component"] and [i.line for i in found["f.javascript"].imports if i.module == "fs"] == [3]
    assert found["null"].symbols == [] and found["null"].line_count == 1


def test_all_call_sites_give_edges(spark):
    lines = ["def early(): ...", "def late(): ...", "", "def f():"] + ["    early()"] * 60 + ["    late()"] + [f"    other{i}()" for i in range(50)]
    rows = spark.createDataFrame([("r", "m.py", "\n".join(lines) + "\n")], "repository string, path string, content string")
    got = {r.target: (r.first_line, r.lines, r["count"]) for r in pycode.resolve(pycode.analyse(rows)).where("kind = 'CALLS'").collect()}
    assert got == {"m.py::early": (5, list(range(5, 25)), 60), "m.py::late": (65, [65], 1)}
    symbol = next(s for s in pycode.analyse_source("\n".join(lines)).symbols if s["name"] == "f")
    assert symbol["called"] == ["early", "late", *[f"other{i}" for i in range(38)]]
