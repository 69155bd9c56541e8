"""Parsing, chunks, stubs, graphs, test output."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.catalog import QUERIES
from codeloom.operators import agents, graph, scan, structure, testruns

PY = "import os, sys as s\nfrom .m import a, b\n\n@dec\ndef f(x):\n    if x and y:\n        return g(x)\n    return f(0)\n\nclass C:\n    def _m(self):\n        return requests.get('u')\n"


def test_parse_python():
    p = structure.parse_source(PY, "python")
    f, m = p["functions"]
    assert (f["name"], f["start_line"], f["end_line"], f["calls"], f["complexity"], f["decorators"], f["is_public"]) == ("f", 5, 8, ["g"], 3, ["@dec"], True)
    assert (m["class"], m["is_public"], m["io_types"]) == ("C", False, ["network"])
    assert [(i["module"], i["alias"], i["import_type"], i["names"]) for i in p["imports"]] == [("sys", "s", "stdlib", []), (".m", None, "local", ["a", "b"])]
    assert p["classes"][0]["methods"] == ["_m"] and not p["has_parse_errors"]


def test_parse_falls_back():
    p = structure.parse_source("class A:\n    def f(self):\n        print 'x'\n\ndef g():\n    pass\n", "python")
    assert p["has_parse_errors"] and [(f["name"], f["class"], f["start_line"], f["end_line"]) for f in p["functions"]] == [("f", "A", 2, 3), ("g", None, 5, 6)]
    assert structure.parse_source("", "python")["functions"] == [] and structure.parse_source(None, None)["has_parse_errors"] is False
    js = structure.parse_source("function f(a) {\n  return g(a);\n}\nconst h = () => {\n}\nimport x from 'y'\n", "javascript")
    assert [(f["name"], f["end_line"]) for f in js["functions"]] == [("f", 3), ("h", 5)] and [i["module"] for i in js["imports"]] == ["y"]
    assert structure.parse_source("x", "cobol")["fallback_mode"] and structure.parse_source("void f(int a) {\n}\n", "cpp")["functions"][0]["name"] == "f"


def test_metrics_and_call_map(spark):
    files = spark.createDataFrame([(PY, "Python"), ("", "Python"), ("int x;", "C#")], "content string, language string")
    a, b, _ = structure.parse(files).withColumn("calls", structure.call_map(F.col("ast"))).collect()
    assert (a.file_metrics.total_lines, a.file_metrics.function_count, a.file_metrics.avg_complexity, a.file_metrics.max_complexity_function) == (13, 2, 2.0, "f")
    assert a.calls == {"f": ["g"], "_m": ["requests.get"]} and b.file_metrics.total_lines == 0


def test_radon_and_methods(spark):
    fs = spark.createDataFrame([("a", 1, "f", "C"), ("a", 2, "f", None), ("a", 3, "g", "D"), ("b", 1, "f", "C")], "file string, ord int, name string, class string")
    measured = spark.createDataFrame([("a", 1, "f", 5, "A"), ("a", 7, "f", 9, "B"), ("a", 3, None, 1, "A"), ("b", 1, "g", 2, "A")], "file string, ord int, name string, complexity int, rank string")
    got = structure.with_radon(fs, measured)
    assert got.columns == [*fs.columns, "radon_complexity", "radon_rank"]
    assert sorted((r.file, r.ord, r.radon_complexity, r.radon_rank) for r in got.collect()) == [("a", 1, 9, "B"), ("a", 2, 9, "B"), ("a", 3, None, None), ("b", 1, None, None)]
    assert sorted((r.file, r.name) for r in structure.methods_of(fs, "C").collect()) == [("a", "f"), ("b", "f")]


def test_measured_functions_have_no_arrays(spark):
    """A file's functions aren't gathered and compared with all of its measures: files grow with the parts."""
    plan = QUERIES["measured_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambda" not in plan


def test_few_files_at_a_time(spark, monkeypatch):
    """A Python worker gets 100 files at most, fewer if the session says so, whatever number a task has."""

    def counted(content, language):
        return pd.DataFrame({"functions": [[]] * len(content), "classes": [[]] * len(content), "imports": [[]] * len(content), "has_parse_errors": False, "error_node_count": len(content), "raw_ast_node_count": 0, "fallback_mode": False})

    monkeypatch.setattr(structure, "_parse_batch", counted)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for own, most in ((10_000, 100), (-1, 100), (7, 7)):
        spark.conf.set(rows, own)
        files = spark.range(1_000, numPartitions=1).select(F.lit(PY).alias("content"), F.lit("Python").alias("language"))
        assert structure.parse(files).agg(F.max("ast.error_node_count")).first()[0] == most
    spark.conf.unset(rows)


def _functions(spark, spans, n):
    rows = [("\n".join(f"l{i}" for i in range(1, n + 1)), [{"name": f"f{k}", "start_line": a, "end_line": b} for k, (a, b) in enumerate(spans)])]
    return spark.createDataFrame(rows, "content string, functions array<struct<name:string,start_line:int,end_line:int>>")


def test_chunks(spark):
    sizes, at, spans = [100, 150, 100, 400, 10], 1, []
    for s in sizes:
        spans.append((at, at + s - 1))
        at += s + 3
    df = _functions(spark, spans, at)
    r = df.select(structure.reader_chunks(F.col("content"), F.col("functions")).alias("r"), structure.parser_chunks(F.col("content"), F.col("functions")).alias("p")).first()
    assert [len(c.code.split("\n")) for c in r.r] == [250, 100, 400, 10] and [c.start_line for c in r.r] == [1, spans[2][0], spans[3][0], spans[4][0]]
    assert r.p[0].start_line == 1 and r.p[-1].end_line == at and all(x.end_line + 1 == y.start_line for x, y in zip(r.p, r.p[1:]))
    one = _functions(spark, [(1, 5)], 20).select(structure.parser_chunks(F.col("content"), F.col("functions")).alias("p")).first().p
    assert [(c.start_line, c.end_line) for c in one] == [(1, 20)]
    lines = spark.range(1, 701).select(F.lit(1).alias("file_id"), F.col("id").cast("int").alias("line_no"))
    assert [r.n for r in structure.line_chunks(lines).orderBy("chunk_index").collect()] == [300, 300, 100]


def test_stubs(spark):
    py = "def a(self, x: int = 1, y=2):\n  pass\n def no():\ndef b():\n"
    js = "function f(x) {}\nconst g = async (y) => 1\nconst h = (z)\n"
    r = spark.range(1).select(structure.python_stubs(F.lit(py)).alias("p"), structure.js_stubs(F.lit(js)).alias("j"), testruns.stubs(F.lit("Python"), F.lit(py)).alias("t"), testruns.stubs(F.lit("Go"), F.lit("")).alias("g")).first()
    assert [(x.name, x.params) for x in r.p] == [("a", ["x", "y"]), ("b", [])]
    assert r.j == [a or b for a, b in re.findall(r"(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s*)?\()", js)]
    assert "# TODO: verify a(None, None) returns expected value" in r.t and r.g == "# No test generation available for this language"


def test_graph(spark):
    symbols = spark.createDataFrame(
        [("1", 0, "a.py", 0, 0, "f", True, ["g", "h.x"]), ("1", 1, "b.py", 0, 0, "g", True, ["g"]), ("1", 1, "b.py", 1, 0, "h", True, None), ("1", 2, "c.py", 0, 0, "g", True, []), ("1", 2, "c.py", 0, 1, "z", False, ["f"])],
        "analysis_id string, file_idx int, path string, kind int, ord int, name string, is_public boolean, calls array<string>",
    )
    exported = graph.exported_symbols(symbols, ("analysis_id",))
    assert {r.name: r.path for r in exported.collect()} == {"f": "a.py", "g": "c.py", "h": "b.py"}
    edges = {(r.caller_id, r.callee_id) for r in graph.cross_file_edges(symbols, exported, ("analysis_id",)).collect()}
    assert edges == {("f@a.py", "g@c.py"), ("f@a.py", "h.x@b.py"), ("g@b.py", "g@c.py"), ("z@c.py", "f@a.py")}
    r = spark.range(1).select(F.create_map(F.lit("a"), F.array(F.lit("b"), F.lit("c"), F.lit("d")), F.lit("e"), F.array().cast("array<string>")).alias("m")).select(graph.busy(F.col("m")).alias("b"), graph.calling_functions(F.col("m")).alias("n"), graph.with_calls(F.col("m")).alias("w")).first()
    assert r.b == ["a"] and r.n == 1 and list(r.w) == ["a"]
    parsed = structure.parse(spark.createDataFrame([("1", 0, "x.py", "from y import g\ndef f(): g()\n", "Python"), ("1", 1, "y.py", "def g(): pass\n", "Python")], "analysis_id string, file_idx int, path string, content string, language string"))
    repo = graph.repository(parsed)
    assert [(r.name, r.paths) for r in repo["call_sites"].collect()] == [("g", ["x.py"])] and [(r.caller_id, r.callee_id) for r in repo["cross_file_graph"].collect()] == [("f@x.py", "g@y.py")]


def test_test_runs(spark):
    rows = [("pytest", "5 passed, 2 failed", 1), ("jest", "x", 0), ("junit", "Tests run: 4, Failures: 1", 1), ("mocha", "", 3)]
    got = [tuple(r.r)[:3] for r in spark.createDataFrame(rows, "f string, o string, c int").select(testruns.parse_output(F.col("f"), F.col("o"), F.col("c")).alias("r")).collect()]
    assert got == [(5, 2, 0), (1, 0, 0), (4, 1, 0), (0, 1, 0)]
    files = spark.createDataFrame([("Python", "x = 1", "x ="), ("Python", "x =", "x ="), ("Go", "", ""), ("JavaScript", "a", "b")], "l string, a string, b string")
    r = [x.r for x in files.select(testruns.run(F.col("l"), F.col("a"), F.col("b")).alias("r")).collect()]
    assert [x.regression_detected for x in r] == [True, False, False, False] and [x.framework_detected for x in r] == ["pytest", "pytest", "auto-generated", "jest"]
    root = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p])
    names = spark.range(1).select(
        testruns.framework(F.lit("Python"), F.create_map(F.lit("t/test_a.py"), F.lit(""))), testruns.framework(F.lit("Go"), F.create_map(F.lit("package.json"), F.lit('{"jest": 1}'))),
        testruns.framework(F.lit("Python"), F.create_map(F.lit("a"), F.lit(""))), testruns.framework(F.lit("Java"), F.create_map(F.lit("pom.xml"), F.lit(""))),
    ).first()
    assert tuple(names) == ("pytest", "jest", "unittest", "junit") and root is not None


def test_agents(spark):
    raw = ['```json\n[{"issue_type": "a", "affected_lines": [1]}]\n```', '{"issues": [{"issue_type": "b"}]}', 'Sure: [{"issue_type": "c"}] ok', "nothing", '{"overall_risk": "LOW"}']
    got = [r.x for r in spark.createDataFrame([(t,) for t in raw], "t string").select(agents.json_list(F.col("t")).alias("x")).collect()]
    assert [x and x[0].issue_type for x in got] == ["a", "b", "c", None, None] and got[0][0].affected_lines == [1]
    o = spark.createDataFrame([(t,) for t in ['{"overall_risk": "LOW"}', 'x {"y": 1} z', "no"]], "t string").select(F.to_json(agents.json_object(F.col("t"), "overall_risk")).alias("x")).collect()
    assert [r.x for r in o] == ['{"overall_risk":"LOW"}', '{"y":1}', None]
    text = "\n".join(f"l{i}" for i in range(1, 11))
    r = spark.range(1).select(agents.snippet(F.lit(text), F.array(F.lit(5))).alias("s"), agents.real_line(F.lit(text), F.lit("l7\nl8")).alias("n"), agents.shift_lines(F.array(F.lit(1)), F.lit(300)).alias("o")).first()
    assert r.s.split("\n") == ["3: l3", "4: l4", "5: l5", "6: l6", "7: l7", "8: l8"] and r.n == 7 and r.o == [301]


SOURCES = {
"javascript":"""import React, {useState as us, b} from 'react'
import * as fs from "fs";
const x = require('path');
// function no() {}
class A extends B {
  #priv = 1;
  constructor(a) { super(a); }
  async hello(x) {
    if (x) { return this.go(x); } else { for (const y of x) {} }
  }
  static get z() { return 1 }
  handle = (e) => { run(e) }
  _hid() { return x ? 1 : 2; }
}
export const add = (a, b) => a + b;
const inc = x => x + 1;
const f2 = async function named(a) {
  function inner() { return 1 }
  return inner();
}
function* gen() { yield 1 }
export default function main(a) { if (a) { go("}"); } }
""",
"java":"""package a;
import java.util.List;
import static org.x.Y.*;
public class Foo extends Bar {
  private int x = 3;
  public Foo(int a) { this.x = a; }
  @Override
  public String toString() { return "x{"; }
  void plain(List<String> a) throws Exception {
    if (a.isEmpty()) { return; } else { while (true) { call(); } }
    return foo(x);
  }
  static <T> Map<String, T> gen(T t) { return t != null ? m : n; }
  abstract void abs();
}
interface I { void one(); int two(String s); }
enum E { A, B }
""",
"cpp":"""#include <vector>
using namespace std;
namespace n {
class Foo : public Bar {
 public:
  Foo(int a) : x(a) {}
  ~Foo() {}
  int get() const { return x; }
  void decl();
};
}
void Foo::bar(int a) {
  if (a > 0) { other(a); } else { do { a--; } while (a); }
}
std::vector<int> make(const std::string& s) {
  return {};
}
int main(int argc, char** argv) { return bar(); }
""",
"c":"struct point { int x; };\nstatic int *add(int a,\n  int b) {\n  return a ? sum(a, b) : 0;\n}\nint decl(int);\nvoid go(void)\n{\n  if (x) y();\n}\n",
"go":'package m\nimport (\n  "fmt"\n  al "net/http"\n)\ntype S struct {\n  a int\n}\nfunc (s *S) Hello(a int) (int, error) {\n  for _, x := range y { fmt.Println(x) }\n  return 1, nil\n}\nfunc low() {}\n',
"rust":"use std::collections::{HashMap, HashSet};\nuse a::b as c;\nextern crate d;\n#[derive(Debug)]\npub struct P<'a> { x: &'a str }\nimpl<'a> P<'a> {\n  pub fn new(x: &'a str) -> Self { P { x } }\n  fn _h(&self) -> i32 { match self.x { \"a\" => 1, _ => 2 } }\n}\ntrait T { fn f(&self); }\n",
"kotlin":"import a.b.C as D\nclass K(val a: Int) {\n  fun hi(x: Int): Int {\n    return if (x > 1) go(x) else 2\n  }\n  fun one() = 1\n}\nfun String.ext(): Int = 3\n",
"swift":"import Foundation\nstruct S {\n  init(a: Int) { self.a = a }\n  func go(_ x: Int) -> Int {\n    guard x > 1 else { return 0 }\n    return call(x)\n  }\n}\nfunc top() {}\n",
"scala":"import a.b.{C, D}\nobject O {\n  def f(x: Int): Int = {\n    if (x > 1) g(x) else 2\n  }\n  def h = 3\n}\n",
"php":"<?php\nuse A\\B;\n# function no() {}\nabstract class C {\n  public function go($x) {\n    foreach ($x as $y) { run($y); }\n  }\n  private static function _p() {}\n}\nfunction top() { return \"function q() {}\"; }\n",
"c_sharp":"using System;\nusing X = A.B;\n[Serializable]\npublic class K : B {\n  public K(int a) : base(a) { }\n  [Test]\n  public async Task<int> Go(string s) {\n    foreach (var x in s) { await Run(x); }\n    return s == null ? 1 : 2;\n  }\n  int Short(int a) => a + 1;\n  private void P() { }\n}\n",
"typescript":"import type { A } from './a';\nexport interface I { go(a: string): void; }\n@Comp({x: 1})\nexport class S<T> {\n  constructor(private a: A) {}\n  public async run(x: number): Promise<void> {\n    if (x) { await this.a.go(x); }\n  }\n}\nexport const h = async (a: string): Promise<void> => {\n  go(a);\n};\n",
"ruby":"require 'json'\nmodule M\n  class C\n    def go(x)\n      run(x) if x\n    end\n    def self.s\n    end\n  end\nend\n",
}

#: By language: (name, class, first line, last line, complexity, public) of the functions, (name, first, last) of the classes, modules.
PARSED = {
    "javascript": (
        [("constructor", "A", 7, 7, 1, True), ("hello", "A", 8, 10, 4, True), ("z", "A", 11, 11, 1, True), ("handle", "A", 12, 12, 1, True), ("_hid", "A", 13, 13, 2, False),
         ("add", None, 15, 15, 1, True), ("inc", None, 16, 16, 1, True), ("f2", None, 17, 20, 1, True), ("gen", None, 21, 21, 1, True), ("main", None, 22, 22, 2, True)],
        [("A", 5, 14)], ["react", "fs", "path"],
    ),
    "typescript": ([("constructor", "S", 5, 5, 1, True), ("run", "S", 6, 8, 2, True), ("h", None, 10, 12, 1, True)], [("S", 4, 9)], ["./a"]),
    "java": (
        [("Foo", "Foo", 6, 6, 1, True), ("toString", "Foo", 8, 8, 1, True), ("plain", "Foo", 9, 12, 4, False), ("gen", "Foo", 13, 13, 2, False), ("abs", "Foo", 14, 14, 1, False)],
        [("Foo", 4, 15), ("I", 16, 16), ("E", 17, 17)], ["java.util.List", "org.x.Y.*"],
    ),
    "cpp": (
        [("Foo", "Foo", 6, 6, 1, True), ("~Foo", "Foo", 7, 7, 1, True), ("get", "Foo", 8, 8, 1, True), ("Foo::bar", "Foo", 12, 14, 4, True), ("make", None, 15, 17, 1, True), ("main", None, 18, 18, 1, True)],
        [("n", 3, 11), ("Foo", 4, 10)], ["vector", "std"],
    ),
    "c": ([("add", None, 2, 5, 2, True), ("go", None, 7, 10, 2, True)], [("point", 1, 1)], []),
    "go": ([("Hello", None, 9, 12, 3, True), ("low", None, 13, 13, 1, False)], [("S", 6, 8)], ["fmt", "net/http"]),
    "rust": ([("new", "P", 7, 7, 1, True), ("_h", "P", 8, 8, 4, True), ("f", "T", 10, 10, 1, True)], [("P", 5, 5), ("P", 6, 9), ("T", 10, 10)], ["std::collections", "a::b", "d"]),
    "kotlin": ([("hi", "K", 3, 5, 3, True), ("one", "K", 6, 6, 1, True), ("ext", None, 8, 8, 1, True)], [("K", 2, 7)], ["a.b.C"]),
    "swift": ([("init", "S", 3, 3, 1, True), ("go", "S", 4, 7, 3, True), ("top", None, 9, 9, 1, True)], [("S", 2, 8)], ["Foundation"]),
    "scala": ([("f", "O", 3, 5, 3, True), ("h", "O", 6, 6, 1, True)], [("O", 2, 7)], ["a.b"]),
    "php": ([("go", "C", 5, 7, 2, True), ("_p", "C", 8, 8, 1, True), ("top", None, 10, 10, 1, True)], [("C", 3, 9)], ["A\\B"]),
    "c_sharp": ([("K", "K", 5, 5, 1, True), ("Go", "K", 7, 10, 3, True), ("Short", "K", 11, 11, 1, False), ("P", "K", 12, 12, 1, False)], [("K", 4, 13)], ["System", "A.B"]),
    "ruby": ([("go", "C", 4, 5, 2, True), ("s", "C", 7, 7, 1, True)], [("M", 2, 9), ("C", 3, 8)], ["json"]),
}


@pytest.mark.parametrize("language", sorted(PARSED))
def test_structure_by_hand(language):
    p, (functions, classes, modules) = structure.parse_source(SOURCES[language], language), PARSED[language]
    assert [(f["name"], f["class"], f["start_line"], f["end_line"], f["complexity"], f["is_public"]) for f in p["functions"]] == functions
    assert [(c["name"], c["start_line"], c["end_line"]) for c in p["classes"]] == classes and [i["module"] for i in p["imports"]] == modules


def test_structure_details():
    by = lambda k: structure.parse_source(SOURCES[k], k)
    js, rust, cs = by("javascript"), by("rust"), by("c_sharp")
    assert [(i["alias"], i["names"]) for i in js["imports"]] == [(None, ["React", "useState", "b"]), ("fs", []), (None, [])]
    assert [f["calls"] for f in js["functions"]][1:5] == [["this.go"], [], ["run"], []] and js["classes"][0]["methods"] == ["constructor", "hello", "z", "handle", "_hid"]
    assert [(i["alias"], i["names"]) for i in rust["imports"]] == [(None, ["HashMap", "HashSet"]), ("c", []), (None, [])] and rust["classes"][0]["decorators"] == ["#[derive(Debug)]"]
    assert by("go")["imports"][1]["alias"] == "al" and cs["functions"][1]["decorators"] == ["[Test]"] and by("java")["functions"][1]["decorators"] == ["@Override"]


@pytest.mark.parametrize("language", [*sorted(PARSED), "python"])
@pytest.mark.parametrize("content", ["", "{", "}}}", "((((", "class", "function (", "'", "/*", "x = {", "a" * 5000 + "(", "f(" * 2000, "import", "\x00{é"])
def test_structure_of_broken_text(language, content):
    p = structure.parse_source(content, language)
    assert all(f["end_line"] >= f["start_line"] >= 1 for f in p["functions"])


def test_complexity_of_a_run(spark):
    files = spark.createDataFrame([(SOURCES["javascript"], "JavaScript"), ("x", "Unknown")], "content string, language string")
    a, b = structure.parse(files).transform(scan.file_scan).select("complexity_before").collect()
    assert (a[0].avg_cyclomatic, a[0].max_cyclomatic, a[0].function_count) == (1.5, 4.0, 10) and b[0] is None
