"""Edits against a plain Python model; diffs; validation; commits."""

import random

from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.operators import edits

KIND = f"content string, changes array<{schemas.EDIT}>"


def change(ord_, old, new, line=0, kind="t", status="validated"):
    return (ord_, kind, old, new, line, line, "why", status)


def model(text, changes):
    """What the edits do, said plainly."""
    applied, rejected = [], []
    for c in sorted(changes, key=lambda c: -(c[4] or 0)):
        old, new, line = c[2] or "", c[3] or "", c[4]
        n = text.count(old) if old else 0
        at = None
        if n == 1:
            at = text.index(old)
        elif n > 1:
            rows = text.splitlines(keepends=True)
            if line and 1 <= line <= len(rows):
                start = sum(map(len, rows[: line - 1]))
                at = text.find(old, start)
                if at < 0:
                    every = [i for i in range(len(text)) if text.startswith(old, i)]
                    at = min(every, key=lambda i: (abs(i - start), i))
        if at is None:
            rejected.append(c[0])
        else:
            text = text[:at] + new + text[at + len(old) :]
            applied.append(c[0])
    return text, applied, rejected


def run(spark, rows):
    df = spark.createDataFrame(rows, KIND).select("content", "changes", edits.apply_edits(F.col("content"), F.col("changes")).alias("e"))
    return [(r.e.text, r.e.applied, [x.ord for x in r.e.rejected]) for r in df.collect()]


def test_against_the_model(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", "ab", "\n", "c\n", "\r\n"]) for _ in range(rng.randrange(14)))
        cs = [change(i, "".join(rng.choice("ab") for _ in range(rng.randrange(3))), rng.choice(["", "X", "ab"]), rng.randrange(6)) for i in range(rng.randrange(5))]
        rows.append((text, cs))
    for row, got in zip(rows, run(spark, rows), strict=True):
        assert got == model(*row), row


def test_cases(spark):
    text = "x = 1\ny = 2\nx = 1\n"
    got = run(spark, [(text, [change(0, "x = 1", "z", 3)]), (text, [change(0, "x = 1", "z", 0)]), (text, [change(0, "", "z", 1)]), (text, []), ("a\nb\nc\nd\ne", [change(0, "a", "1", 1), change(1, "e", "5", 5)])])
    assert got[0][0] == "x = 1\ny = 2\nz\n"
    assert got[1] == (text, [], [0]) and got[2] == (text, [], [0]) and got[3] == (text, [], [])
    assert got[4][1] == [1, 0]


def test_diff(spark):
    rows = [("a\nb\nc\n", "a\nX\nc\n"), ("-- c\nx\n", "x\n"), ("a\n", "a\nb\n"), ("", ""), ("a\n", "a\n"), ("", "x")]
    got = [r.d for r in spark.createDataFrame(rows, "a string, b string").select(edits.diff(F.col("a"), F.col("b")).alias("d")).collect()]
    assert (got[0].minimality_score, got[0].lines_changed, got[0].total_lines) == (66.67, 1, 3)
    assert (got[1].minimality_score, got[1].lines_changed) == (100.0, 0)
    assert got[2].lines_changed == 0 and got[3].minimality_score == 100.0 and got[4].unified_diff == "" and got[5].minimality_score == 100.0
    assert got[0].unified_diff.startswith("--- original+++ modernized@@")


def test_same_code_and_validation(spark):
    r = spark.range(1).select(edits.same_code(F.lit(" a b\n"), F.lit("ab")).alias("x"), edits.same_code(F.lit(""), F.lit("")).alias("y"), edits.same_code(F.lit(None).cast("string"), F.lit("a")).alias("z")).first()
    assert (r.x, r.y, r.z) == (True, False, False)
    from codeloom.operators import structure

    f = spark.createDataFrame([("import os\ndef f(): pass\ndef g(): pass\n", "import sys\ndef f(): pass\n", "Python")], "content string, after string, language string")
    p = structure.parse(f).withColumnRenamed("ast", "before").drop("file_metrics")
    p = structure.parse(p, content="after")
    v = p.select(edits.validate(F.col("before"), F.col("ast")).alias("v"), edits.validate_strict(F.col("before"), F.col("ast")).alias("s")).first()
    assert not v.v.validation_passed and v.v.ast_valid and v.v.unexpected_imports == ["sys"] and v.s.missing_functions == ["g"] and v.s.complexity_delta == -1


def test_commit(spark):
    files = spark.createDataFrame([("a", "f", "x = 1"), ("a", "g", "y"), ("a", "h", "z")], "analysis_id string, file_path string, content string")
    rows = [("a", "f", *change(0, "x", "w", 1, "b", "accepted")), ("a", "f", *change(1, "1", "2", 1, "a", "accepted")), ("a", "g", *change(0, "nope", "w", 1, "a", "accepted")), ("a", "h", *change(0, "z", "w", 1))]
    changes = spark.createDataFrame(rows, "analysis_id string, file_path string, ord int, issue_type string, old_code string, new_code string, line_start int, line_end int, reason string, status string")
    got = edits.commit(files, changes).collect()
    assert [(r.file_path, r.modified, r.message) for r in got] == [("f", "w = 2", "Modernize: a, b")]
