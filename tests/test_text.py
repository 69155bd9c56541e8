"""Text functions agree with Python's own."""

import random

from pyspark.sql import functions as F

from codeloom.functions.text import lines, n_lines_parser, occurrences, pieces, quoted, strip

CHARS = ["a", "b", " ", "\n", "\r", "\r\n", "\x0b", "\f", "\x1c", "\x85", "\u2028", "é", "'", '"', "\\", "\t"]


def _texts(n=400):
    rng = random.Random(1)
    return ["", "\n", "a\n", *("".join(rng.choice(CHARS) for _ in range(rng.randrange(12))) for _ in range(n))]


def test_lines_pieces_strip(spark):
    df = spark.createDataFrame([(t,) for t in _texts()], "t string")
    t = F.col("t")
    for r in df.select("t", lines(t).alias("l"), pieces(t).alias("p"), strip(t).alias("s"), n_lines_parser(t).alias("n")).collect():
        assert r.l == r.t.splitlines(), repr(r.t)
        assert r.p == r.t.splitlines(keepends=True), repr(r.t)
        assert r.s == r.t.strip(), repr(r.t)
        assert r.n == (r.t.count("\n") + 1 if r.t.strip() else 0)


def test_occurrences_quoted(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randrange(10))), "".join(rng.choice("ab") for _ in range(rng.randrange(4)))) for _ in range(200)]
    for r in spark.createDataFrame(rows, "t string, p string").select("t", "p", occurrences(F.col("t"), F.col("p")).alias("n")).collect():
        assert r.n == (r.t.count(r.p) if r.p else 0)
    plain = ["a'b", 'a"b', "a'\"b", "x\ny\tz\\", "é"]
    for r in spark.createDataFrame([(t,) for t in plain], "t string").select("t", quoted(F.col("t")).alias("q")).collect():
        assert r.q == repr(r.t)
