"""Languages, eras, findings, secrets, imports."""

import re

import pytest
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.operators import language, scan


@pytest.mark.parametrize(
    ("path", "want"),
    [("a.py", "Python"), ("x.R", "R"), (".bashrc", None), ("a.h", None), ("d.x/a.TS", "TypeScript"), ("x.", None), ("a.tar.js", "JavaScript"), ("noext", None)],
)
def test_extension(spark, path, want):
    assert spark.range(1).select(language.by_extension(F.lit(path))).first()[0] == want


CASES = [
    ("v.x", "var x = () => {\n}", "Unknown", "unknown"),
    ("a.js", "var x;\nf(() => {\n})", "JavaScript", "ES5"),
    ("A.unknown", "import java.util.List;\npublic class A {", "Python", "Python (modern)"),
    ("a.py", "print 'x'\nasync def f(): pass", "Python", "2.x"),
    ("a.py", "async def f(): pass\nif (n := 1): pass", "Python", "3.5+"),
    ("a.h", "#include <x.h>", "C", "C (modern)"),
    ("a.h", "#include <vector>", "C++", "C++ (modern)"),
    ("a.go", "", "Go", "Go (modern)"),
    ("A.java", "StringBuffer b; Optional.of(1)", "Java", "Java7-"),
]


def test_detect(spark):
    df = language.detect(spark.createDataFrame([(p, c) for p, c, *_ in CASES], "path string, content string"))
    got = {(r.path, r.content): r for r in df.collect()}
    for p, c, lang, era in CASES:
        assert (got[p, c].language, got[p, c].era) == (lang, era), p
    assert got["a.js", CASES[1][1]].version_hint == "var declarations — pre-ES6; arrow functions — ES6+"
    assert got["a.go", ""].version_hint == "Go (no era markers detected)" and got["a.go", ""].confidence == "medium"


def test_every_signature_can_be_found(spark):
    """Each signature is found in a text made for it by the same expression in Python."""
    texts = [
        "print 'x'", "print (", "xrange(1)", "d.has_key(k)", "except E, e", "urllib2", "raw_input()", "# coding: utf-8", "basestring", "unicode(x)", "await x", "f'{x}'", "a := 1", "match x",
        "var a", "function (", ".then(", "XMLHttpRequest", "prototype.", "require(", "const x = (", "=> {", "async function", "import x from 'y'",
        "ArrayList l = new ArrayList()", "for (int i = 0", "StringBuffer b", "System.out.println", "@Override public", "List<", "Optional.", "stream().", "var x =",
    ]
    for lang, rows in rules.ERAS.items():
        for regex, era, hint in rows:
            text = next(t for t in texts if re.search(regex, t, re.M))
            hits = spark.range(1).select(language.era_hits(F.lit(lang), F.lit(text))).first()[0]
            assert (era, hint) in [(h.era, h.hint) for h in hits]


def test_breakdown_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", "Go")] + [("a", "C")] * 7 + [("b", None)], "analysis_id string, language string")
    got = {(r.analysis_id, r.language): (r.files, r.percent) for r in language.breakdown(df).collect()}
    assert got == {("a", "Go"): (1, 12), ("a", "C"): (7, 88), ("b", "Unknown"): (1, 100)}
    assert {r.analysis_id: r.language_breakdown for r in language.breakdown_map(df).collect()} == {"a": {"Go": 12, "C": 88}, "b": {"Unknown": 100}}


HITS = ['password = "hunter22"', 'api_key = "abcd1234"', "secret = 'abcdefgh'", 'q = "a" + tbl + "SELECT"', 'db.execute("select " + x)', "el.innerHTML = v", "document.write(v)", 'exec("ls $HOME")', "x = eval (y)", "h = MD5(x)", 'get("http://a.example")']
MISSES = ['password = "abc"', 'api_key = "short"', "secrets: yes", '"SELECT" + tbl', "db.execute(sql)", "innerText = v", "document.writeln", "exec(cmd)", "evaluate(y)", "amd5x", "https://a.example"]


def test_generic_rules(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(HITS)] + [(2, i, t) for i, t in enumerate(MISSES)], "file_id int, line_no int, line string")
    got = scan.findings(df).collect()
    assert {(r.line_no, r.rule_ord) for r in got if r.file_id == 1} >= {(i, i) for i in range(11)}
    assert not [r for r in got if r.file_id == 2]
    by = {r.file_id: r for r in scan.summary(df).collect()}
    assert by[2].gate_passed and not by[1].gate_passed and by[1].high == 7 and by[1].low == 1


def test_file_scan_equals_line_scan(spark):
    files = spark.createDataFrame([("x.js", "\n".join(HITS) + "\npassword: longenough", "JavaScript"), ("y.py", "eval(x)\nassert y", "Python"), ("z.js", "", "JavaScript")], "path string, content string, language string")
    got = {r.path: r for r in scan.file_scan(files).collect()}
    assert [f.line for f in got["y.py"].security_findings] == [1, 2] and got["y.py"].risk_summary.asDict() == {"high": 1, "medium": 0, "low": 1, "secrets": 0}
    assert got["x.js"].risk_summary.secrets == 2 and not got["x.js"].security_gate_passed
    assert got["z.js"].security_findings == [] and got["z.js"].security_gate_passed
    rows = scan.findings(scan.explode_lines(files), python=F.col("language") == "Python").groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in rows} == {p: len(r.security_findings) for p, r in got.items() if r.security_findings}


@pytest.mark.parametrize(
    ("module", "lang", "want"),
    [("java.util.List", "java", "third_party"), ("os", "python", "stdlib"), ("os.path", "python", "stdlib"), ("utils", "python", "local"), (".models", "python", "local"), ("my-lib", "python", "third_party"), ("_", "python", "third_party"), ("fs", "go", "local")],
)
def test_import_class(spark, module, lang, want):
    from codeloom.operators.structure import _import_class

    assert spark.range(1).select(scan.import_class(F.lit(module), F.lit(lang))).first()[0] == want == _import_class(module, lang)


def test_io(spark):
    r = spark.range(1).select(scan.io_types(F.lit("requests.get; open(f)")).alias("t"), scan.io_imports(F.array(F.lit("audio"), F.lit("x"))).alias("m"), scan.complexity(F.array(F.lit(1), F.lit(4))).alias("c"), scan.complexity(F.array().cast("array<int>")).alias("n")).first()
    assert r.t == ["network", "file_io"] and r.m == ["audio"] and r.c.asDict() == {"avg_cyclomatic": 2.5, "max_cyclomatic": 4.0, "function_count": 2} and r.n is None
