"""Scanned languages: what is declared, imported and referred to, with spans that hold whole declarations."""

import random
import time

import pytest

from graphloom.sources import extract as ex
from graphloom.sources import lexical

CASES = {
    "typescript": (
        'import {a} from "./x";\n// import "no";\nconst s = "class Fake {";\nexport class A extends B implements C {\n'
        "  get(y: string): string { if (y) { foo(y); } return `class Z {`; }\n}\n"
        "export const f = async (x: number): Promise<void> => {\n  function local() {}\n  bar(x);\n}\ntype U = string | 1;\n",
        {("import", "./x", None), ("class", "A", None), ("method", "get", "A"), ("function", "f", None), ("type", "U", None)},
        {("subclassOf", "A", "B"), ("subclassOf", "A", "C"), ("calls", "get", "foo"), ("calls", "f", "bar"), ("calls", "f", "local")},
    ),
    "rust": (
        "use std::{io::{Write, Read}, fmt as f};\nmod m { pub fn inner() { helper(); } }\n"
        "impl<T> Display for S<T> { fn fmt(&self) -> R { let c = '{'; write(self) } }\ntrait Tr { fn sig(&self); }\nconst K: u8 = 1;\n",
        {("import", "std::io::Write", None), ("import", "std::io::Read", None), ("import", "std::fmt", None), ("mod", "m", None),
         ("function", "inner", None), ("impl", "S", None), ("method", "fmt", "S"), ("trait", "Tr", None), ("method", "sig", "Tr"),
         ("const", "K", None)},
        {("calls", "inner", "helper"), ("calls", "fmt", "write"), ("subclassOf", "S", "Display")},
    ),
    "go": (
        'package x\nimport "fmt"\nimport (\n\tc "d/e"\n)\ntype S struct { A int }\ntype I interface {\n\tM() error\n}\ntype N int\n'
        "func F(a int) (int, error) {\n\treturn G(a)\n}\nfunc (s *S) M() error { return nil }\n",
        {("import", "fmt", None), ("import", "d/e", None), ("struct", "S", None), ("interface", "I", None), ("type", "N", None),
         ("function", "F", None), ("method", "M", "S")},
        {("calls", "F", "G")},
    ),
    "java": (
        "import java.util.List;\npublic class K extends L implements M {\n  private int x = f();\n  public K() { this.x = 1; }\n"
        "  public <T> List<T> m(int a) throws E { if (a > 0) { return g(a); } return null; }\n  enum E2 { A }\n}\n"
        "interface J { void q(int a); }\nrecord R(int a) {}\n",
        {("import", "java.util.List", None), ("class", "K", None), ("constructor", "K", "K"), ("method", "m", "K"), ("enum", "E2", "K"),
         ("interface", "J", None), ("method", "q", "J"), ("record", "R", None)},
        {("subclassOf", "K", "L"), ("subclassOf", "K", "M"), ("calls", "m", "g")},
    ),
    "kotlin": (
        "import a.b.C\nclass K(val x: Int) : L(), M {\n  fun m(): Int = g(x)\n  fun n() { h() }\n}\nfun String.top(a: Int): Int {\n  return a\n}\n",
        {("import", "a.b.C", None), ("class", "K", None), ("method", "m", "K"), ("method", "n", "K"), ("function", "top", None)},
        {("subclassOf", "K", "L"), ("subclassOf", "K", "M"), ("calls", "n", "h")},
    ),
    "swift": (
        "@testable import struct M.S\nclass K: NSObject, P {\n  func m(a: Int) -> Int { return f(a) }\n}\nprotocol P { func z() }\n",
        {("import", "M.S", None), ("class", "K", None), ("method", "m", "K"), ("class", "P", None), ("method", "z", "P")},
        {("subclassOf", "K", "NSObject"), ("subclassOf", "K", "P"), ("calls", "m", "f")},
    ),
    "ruby": (
        "require_relative 'a/b'\nmodule M\n  class K < Base\n    def self.x(a)\n      if a\n        foo(a)\n      end\n      y = 1 if a\n    end\n"
        "    def z?\n      while true do\n        bar()\n      end\n    end\n  end\nend\ndef top\nend\n",
        {("import", "a/b", None), ("class", "M", None), ("class", "K", "M"), ("method", "x", "K"), ("method", "z?", "K"),
         ("method", "top", None)},
        {("subclassOf", "K", "Base"), ("calls", "x", "foo"), ("calls", "z?", "bar")},
    ),
    "c": (
        '#include "a.h"\n#define MAX(a,b) ((a) > (b) ? \\\n  (a) : (b))\ntypedef unsigned int u32;\nstruct s { int a; };\n'
        "static int f(int a, char *b)\n{\n  for_each(x) { g(a); }\n  return h(b);\n}\nint proto(int a);\n",
        {("import", "a.h", None), ("macro", "MAX", None), ("typedef", "u32", None), ("struct", "s", None), ("function", "f", None)},
        {("calls", "f", "for_each"), ("calls", "f", "g"), ("calls", "f", "h")},
    ),
    "cpp": (
        "namespace n {\nclass K : public B, private C {\n public:\n  K(int a) : a_(a) {}\n  ~K() {}\n  int get() const override { return f(a_); }\n};\n"
        'int K2::m(int x) { return g(x); }\n}\nextern "C" { void c1() {} }\n',
        {("namespace", "n", None), ("class", "K", None), ("constructor", "K", "K"), ("method", "~K", "K"), ("method", "get", "K"),
         ("method", "m", "K2"), ("function", "c1", None)},
        {("subclassOf", "K", "B"), ("subclassOf", "K", "C"), ("calls", "get", "f"), ("calls", "m", "g")},
    ),
    "objective-c": (
        '#import "K.h"\n@interface K : NSObject <P>\n- (void)m:(int)a;\n@end\n@implementation K\n- (void)n:(int)a { foo(a); }\n@end\n'
        "static void cf(int a) { bar(a); }\n",
        {("import", "K.h", None), ("class_interface", "K", None), ("method", "m", "K"), ("class_implementation", "K", None),
         ("method", "n", "K"), ("function", "cf", None)},
        {("subclassOf", "K", "NSObject"), ("calls", "n", "foo"), ("calls", "cf", "bar")},
    ),
    "cfml": (
        '<cfcomponent displayname="Comp" extends="a.Base">\n<cffunction name="doIt"><cfinclude template="x.cfm"></cffunction>\n</cfcomponent>\n',
        {("import", "a.Base", None), ("import", "x.cfm", None), ("component", "Comp", None), ("method", "doIt", "Comp")},
        set(),
    ),
}


@pytest.mark.parametrize("language", CASES)
def test_language(language):
    text, want, refs = CASES[language]
    got = list(lexical.items(language, text))
    assert {x[:3] for x in got} == want and len(got) == len(want)
    assert {r[:3] for r in lexical.references(language, text)} == refs
    for kind, name, _, begin, end, a, b in got:
        if kind != "import":
            part = text.encode()[a:b].decode()
            assert name in part and begin <= end and part.count("\n") == end - begin
    shifted = list(lexical.items(language, "\n" + text))
    assert [x[:3] for x in shifted] == [x[:3] for x in got]


def test_broken_and_long_texts():
    r = random.Random(3)
    for language, (text, _, _) in CASES.items():
        for _ in range(20):
            cut = list(text)
            for _ in range(5):
                cut[r.randrange(len(cut))] = r.choice("{}()[]\"'`/*\\\n;é")
            list(lexical.items(language, "".join(cut)))
            list(lexical.references(language, "".join(cut)))
        assert list(lexical.items(language, "")) == []
        t = time.time()
        n = len(list(lexical.items(language, text * (300_000 // len(text)))))
        assert n and time.time() - t < 20, language


def test_references_resolve(spark):
    files = spark.createDataFrame(
        [
            ("a/p/K.java", "java", "import a.q.L;\nclass K extends L { void m() { n(); z(); both(); gone(); } void n() {} }"),
            ("a/q/L.java", "java", "class L { void both() {} void only() {} }"),
            ("a/q/Z.java", "java", "class Z { void z() {} void both() {} }"),
            ("a/q/N.py", "python", "class N(Z):\n    def f(self):\n        g()\ndef g():\n    pass\n"),
            ("bad.py", "python", "def ("),
            ("null.java", "java", None),
        ],
        "path string, language string, text string",
    )
    items = ex.extract(files).cache()
    specs = items.where("kind = 'import'").select("path", items["name"].alias("spec"))
    imports = ex.resolve_qualified(specs, files, [".java"])
    assert [tuple(x) for x in imports.collect()] == [("a/p/K.java", "a.q.L", "a/q/L.java", "exact")]
    edges, unresolved = ex.resolve_references(ex.references(files), items, imports)
    assert {(e.src, e.dst, e.target, e.how) for e in edges.collect()} == {
        ("K", "L", "a/q/L.java", "import"), ("m", "n", "a/p/K.java", "exact"), ("m", "z", "a/q/Z.java", "heuristic"),
        ("m", "both", "a/q/L.java", "import"), ("N", "Z", "a/q/Z.java", "heuristic"), ("f", "g", "a/q/N.py", "exact"),
    }
    assert {(e.dst, e.reason) for e in unresolved.collect()} == {("gone", "undeclared")}


def test_qualified_and_go(spark):
    paths = spark.createDataFrame([("s/a/b/C.kt",), ("s/a/b/D.kt",), ("t/x/E.kt",), ("u/x/E.kt",), ("g/z_test.go",), ("g/y.go",), ("m.go",)], "path string")
    specs = spark.createDataFrame(
        [("k", "a.b.C"), ("k", "a.b.D.member"), ("k", "a.b.*"), ("k", "x.E"), ("o", "ex.com/r/g"), ("o", "ex.com/r"), ("o", "fmt")], "path string, spec string"
    )
    got = {(r.spec, r.target, r.how) for r in ex.resolve_qualified(specs, paths, [".kt"]).collect()}
    assert got == {
        ("a.b.C", "s/a/b/C.kt", "exact"), ("a.b.D.member", "s/a/b/D.kt", "member"),
        ("a.b.*", "s/a/b/C.kt", "package"), ("a.b.*", "s/a/b/D.kt", "package"),
    }
    assert {(r.spec, r.target) for r in ex.resolve_go(specs, paths, "ex.com/r").collect()} == {("ex.com/r/g", "g/y.go"), ("ex.com/r", "m.go")}
