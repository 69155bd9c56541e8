"""Signatures, edits of long files, versions, nesting and strict JSON in their hard cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codeloom.operators import agents, edits, nesting, versions
from codeloom.sources import files as sources

# Keys, data and results of RFC 4231, cases 1, 2, 3, 6 and 7.
RFC_4231 = (
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.", "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
)


def test_hmac_of_the_standard(spark):
    df = spark.createDataFrame(RFC_4231, "k binary, d binary, want string")
    made = df.select("want", sources.hmac_sha256(F.col("d"), F.col("k")).alias("got"))
    assert all(r.want == r.got for r in made.collect())
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame([("x", None), (None, "sha256=1")], "b string, s string").select(sources.signed(F.col("b"), F.col("s"), b"key").alias("ok"))
    assert [r.ok for r in one.collect()] == [False, False]


EDIT = "array<struct<ord:int,issue_type:string,old_code:string,new_code:string,line_start:int>>"


def slow_edits(text, changes):
    for _, _, old, new, line in sorted(changes, key=lambda c: (-(c[4] or 0), c[0])):
        count = text.count(old) if old else 0
        places = [i for i in range(len(text)) if old and text.startswith(old, i)]
        if count == 1:
            at = text.find(old)
        elif count > 1 and line and 0 < line <= len(text.splitlines()):
            start = sum(len(x) for x in text.splitlines(keepends=True)[: line - 1])
            at = min(places, key=lambda p: (p < start, p if p >= start else start - p))
        else:
            continue
        text = text[:at] + new + text[at + len(old) :]
    return text


@pytest.mark.parametrize("seed", range(3))
def test_edits_by_line(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        text = "".join(rng.choice(["aa", "ab", "\n", "aaa\n", "é😀\n", "b"]) for _ in range(rng.randrange(40)))
        rows.append((i, text, [(k, "t", rng.choice(["aa", "ab", "aaa", "\n", "", "b\n", "zz"]), rng.choice(["", "X", "aa", "q\nr"]), rng.choice([None, 0, 1, 3, 7, 30])) for k in range(5)]))
    df = spark.createDataFrame(rows, f"i int, t string, c {EDIT}")
    got = {r.i: r.x for r in df.select("i", edits.apply_edits(F.col("t"), F.col("c"))["text"].alias("x")).collect()}
    assert got == {i: slow_edits(t, c) for i, t, c in rows}


def test_edits_of_a_long_file_are_linear(spark):
    def seconds(lines):
        text = "value = old_call(1)\n" * lines
        df = spark.createDataFrame([(text, [(k, "t", "old_call(1)", "new", lines // 2 + k) for k in range(4)])], f"t string, c {EDIT}").cache()
        df.count()
        began = time.process_time(), time.perf_counter()
        got = df.select(edits.apply_edits(F.col("t"), F.col("c"))["text"].alias("x")).first().x
        assert got.count("new") == 4 and got.split("\n").index("value = new") == lines // 2 - 1
        return time.perf_counter() - began[1]

    seconds(100)
    assert seconds(26_000) < 20  # 520 KB; trying every offset would take hours


def test_versions_of_files(spark):
    before = [(1, 1, "def a(x, y):"), (1, 2, "def b():"), (1, 3, "def a():"), (1, 4, None), (1, 5, "import os"), (2, 1, ""), (3, 1, "func Go(x int) {"), (3, 2, "fn rs(&mut self, n: u8) {")]
    after = [(1, 1, "def a(x):"), (1, 2, "from os.path import x"), (1, 3, "import os"), (3, 1, "func Go(x int) {"), (3, 9, "async def new(self, *, k=1):"), (4, 1, "def only():")]
    kind = "file_id int, line_no int, line string"
    old, new = spark.createDataFrame(before, kind), spark.createDataFrame(after, kind)
    got = {(r.file_id, r.name): (r.change, r.arity_before, r.arity_after) for r in versions.changed_functions(old, new).collect()}
    assert got == {(1, "a"): ("arity", 2, 1), (1, "b"): ("missing", 0, None), (3, "Go"): ("same", 1, 1), (3, "rs"): ("missing", 1, None), (3, "new"): ("new", None, 2), (4, "only"): ("new", None, 0)}
    verdict = {r.file_id: r for r in versions.verdicts(old, new).collect()}
    assert set(verdict) == {1, 2, 3} and verdict[1].missing == ["b"] and verdict[1].arity_changes == 1 and verdict[1].unexpected_imports == ["os.path"] and not verdict[1].signatures_preserved
    assert verdict[2].signatures_preserved and verdict[2].issues == [] and verdict[3].issues == ["Functions removed from modified file: rs"]
    assert versions.changed_functions(old.limit(0), new.limit(0)).count() == 0


def test_a_parent_with_a_third_of_all_children(spark):
    children = [(0, i, "hot") for i in range(1000)] + [(1 + i % 500, 1000 + i, "x") for i in range(2000)] + [(None, -1, "lost"), (9999, -2, "no parent")]
    kids = spark.createDataFrame(children, "id long, ord long, what string")
    parents = spark.createDataFrame([(i, f"p{i}") for i in range(502)], "id long, name string")
    got = nesting.nest(parents, kids, "id", ["ord", "what"], F.col("ord"), rows=50).collect()
    assert max(len(r.children) for r in got) <= 100 and {r.parts for r in got if r.id == 0} == {20} and len([r for r in got if r.id == 0]) == 20
    assert sorted((r.id, c["ord"]) for r in got for c in r.children) == sorted((i, o) for i, o, w in children if w in ("hot", "x"))
    assert [(r.name, r.part, r.parts, r.children) for r in got if r.id == 501] == [("p501", 0, 1, [])]
    assert all([c["ord"] for c in r.children] == sorted(c["ord"] for c in r.children) for r in got)


@pytest.mark.parametrize(
    ("text", "good"), [('{"a": 1}', True), ('{"a": 1} x', False), ('{"a": 1}, {"a": 2}', False), ("1] [2", False), ('{"a": 1}]', False), ("", False), (None, False), ("null", True), ("[1, 2]", True), ("{", False), (' \n{"a": [1]} ', True)]
)
def test_strict_json(spark, text, good):
    df = spark.createDataFrame([(text,)], "t string")
    assert (df.select(F.to_json(agents.strict_json(F.col("t"))).alias("j")).first().j is not None) == good


def test_answers_keep_bad_rows_apart(spark):
    raw = ['[{"k": 1}]', '```json\n[{"k": 2}, {"k": 3}]\n```', '{"findings": [{"k": 4}]}', 'so: [{"k": 5}] ok', '{"k": 6}', "[1, 2", None, "", '{"issues": {}, "results": []}']
    got = agents.read_answers(spark.createDataFrame(list(enumerate(raw)), "i int, raw string"), "raw", element="struct<k:int>").collect()
    assert {r.i: (r["items"] and [x.k for x in r["items"]], r.problem) for r in got} == {
        0: ([1], None), 1: ([2, 3], None), 2: ([4], None), 3: ([5], None), 4: (None, "no list"), 5: (None, "no JSON"), 6: (None, "no answer"), 7: (None, "no JSON"), 8: ([], None),
    }
