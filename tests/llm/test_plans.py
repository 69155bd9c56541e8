"""Sharding, filter audit and fill-in-the-middle against plain models, SQL and hard cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom.llm import op11_sharding as op11
from codeloom.llm import op12_audit as op12
from codeloom.llm import op13_fim as op13
from codeloom.llm.common import let

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def by_sql(sql, rows, labels=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    for table, got in (("documents", rows), ("labels", labels)):
        if got:
            con.executemany(f"INSERT INTO {table} VALUES (?, ?, ?)", [list(r) for r in got])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return Counter(tuple(sorted(zip(names, r, strict=True))) for r in result.fetchall())


def as_counter(df):
    return Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


# --- sharding -----------------------------------------------------------------------------------------------------


def slow_capacity(sizes, shards):
    """Tries every partition's largest shard by dynamic programming."""
    sums = [0, *itertools.accumulate(sizes)]
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], sums[i] - sums[j]) for j in range(i)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize(("n", "shards"), [(1, 1), (3, 5), (40, 1), (40, 4), (60, 16), (90, 7)])
def test_smallest_capacity(spark, n, shards):
    rng = random.Random(n * shards)
    sizes = [rng.choice([1, 5, 30, 300, rng.randrange(1, 900)]) for _ in range(n)]
    df = spark.createDataFrame([(sizes, shards)], "sizes array<bigint>, left int")
    capacity = op11._smallest_capacity(F.col("sizes"), F.col("left"))
    c, cuts = df.select(capacity, let(capacity, lambda c: op11._cuts(F.col("sizes"), F.col("left"), c))).first()
    bounds = [0, *cuts, n]
    parts = [sum(sizes[a:b]) for a, b in itertools.pairwise(bounds)]
    assert c == slow_capacity(sizes, shards) and max(parts) <= c and len(parts) <= shards and bounds == sorted(bounds)


def _shard_rows():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma δέλτα epsilon ζ 中文 😀".split()) for _ in range(n))
    rows = [(i, prose(rng.randrange(1, 60)), "en") for i in range(900)]
    rows += [(2000 + i, "a text with many copies " * 9, "en") for i in range(400)]  # a third of all bytes
    rows += [(7, "one row many times", None)] * 300 + [(None, "no id", "x")] * 40 + [(None, None, None), (8, None, "a"), (9, "", "a"), (10, "w " * 5000, "a")]
    return rows


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(op11, "BUCKET", 64)
    rows = _shard_rows()
    df = spark.createDataFrame(rows, DOCS)
    got = op11.assign(df.withColumn("shard", F.lit("mine"))).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    size, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of[r.text_crc32, r["size"]].add(r.shard)
    assert set(size) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    # The copies have a shard of their own, the others are near to their mean.
    group = Counter()
    for _, t, _ in rows:
        group[t or ""] += len((t or "").encode()) + 1
    sizes, hot = sorted(size.values()), max(group.values())
    rest = (sum(sizes) - hot) / 15
    assert sizes[-1] == hot > 3 * rest and all(abs(s - rest) <= sorted(group.values())[-2] for s in sizes[:-1])
    assert as_counter(op11.assign(df.repartition(9))) == as_counter(op11.assign(df))


def test_shards_sql(spark):
    rows = _shard_rows()
    assert as_counter(op11.assign(spark.createDataFrame(rows, DOCS))) == by_sql(op11.ORACLE_SQL, rows)
    few = rows[:5]
    assert as_counter(op11.assign(spark.createDataFrame(few, DOCS))) == by_sql(op11.ORACLE_SQL, few)
    assert op11.assign(spark.createDataFrame([], DOCS)).count() == 0


def test_documents_with_shards(spark):
    df = spark.createDataFrame(_shard_rows(), DOCS).withColumn("shard", F.lit("mine"))
    got = op11.with_shards(df)
    assert got.columns == [*df.columns, "shard_"]
    want = as_counter(op11.assign(df).groupBy("shard").count())
    assert as_counter(got.groupBy(F.col("shard_").alias("shard")).count()) == want and got.where("shard = 'mine'").count() == df.count()


# --- filter audit -------------------------------------------------------------------------------------------------


def _audit_rows():
    rng = random.Random(5)
    texts = []
    for _ in range(160):
        n = rng.choice([0, 20, 120, 200])
        vocabulary = [f"w{k}" for k in range(rng.choice([10, 400]))]
        text = " ".join(rng.choice(vocabulary) for _ in range(n))
        texts.append((text.upper() if rng.random() < 0.3 else text) + (" & more" if rng.random() < 0.3 else ""))
    texts += [None, "", "A", "é", "|", "x\x0by\x1cz", "One line\n" * 3000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(500)]
    rows += [(600, "copy " * 120, "en")] * 3 + [(None, "copy " * 120, "en")] * 4 + [(601 + i, "copy " * 120, "fr") for i in range(30)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 700, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def slow_audit(rows, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if x == 1 else set()
    out, removed_at = Counter(), Counter()
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((part or "", i, {f for f in fails if fails[f]}))
    keys = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, i, fails in docs:
            first = next((f for f in order if f in fails), None)
            for k, f in enumerate(order):
                gone = first is not None and order.index(first) < k
                taken = first == f
                values = (not gone and not taken, taken, gone and f in fails, fails == {f}, taken and i in good, taken and i in toxic)
                for key, v in zip(keys, values, strict=True):
                    out[part, order, k + 1, key] += v
                removed_at[part, f] += taken
    return out, removed_at, keys, {p for p, _, _ in docs}


def test_audit(spark):
    rows, labels = _audit_rows()
    out, removed, keys, parts = slow_audit(rows, labels)
    got = op12.audit(spark.createDataFrame(rows, DOCS).withColumn("mask", F.lit("mine")), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(parts) * 600 and {r.part for r in got} == parts
    for r in got:
        assert {k: r[k] for k in keys} == {k: out[r.part, r.filter_order, r.step, k] for k in keys}
        assert r.shapley == removed[r.part, r.filter_order[r.step - 1]]


def test_audit_sql(spark):
    rows, labels = _audit_rows()
    assert as_counter(op12.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))) == by_sql(op12.ORACLE_SQL, rows, labels)
    none = spark.createDataFrame([], DOCS)
    assert op12.audit(none, spark.createDataFrame(labels, LABELS)).count() == 0
    alone = op12.audit(spark.createDataFrame(rows[:9], DOCS), spark.createDataFrame([], LABELS))
    assert as_counter(alone) == by_sql(op12.ORACLE_SQL, rows[:9])


def test_parity_sums_invert(spark):
    """Masks' counts survive the transform and its inverse, the part with one document as well."""
    rng = random.Random(6)
    rows = [(rng.choice("pq"), rng.randrange(32), rng.randrange(2), rng.randrange(2)) for _ in range(400)] + [("r", 31, 1, 0)]
    df = spark.createDataFrame(rows, "part string, mask int, good int, toxic int")
    sums = op12.parity_sums(df)
    assert all(r.docs[0] == sum(x[0] == r.part for x in rows) for r in sums.collect())
    for r in op12.cells(sums).collect():
        for measure, column in (("docs", lambda x: 1), ("good", lambda x: x[2]), ("toxic", lambda x: x[3])):
            assert r[measure] == [sum(column(x) for x in rows if x[0] == r.part and x[1] == m) for m in range(32)]


# --- fill in the middle -------------------------------------------------------------------------------------------


def slow_fim(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def _fim_rows():
    rng = random.Random(7)
    letters = "ab \n\r\té😀́‍\x00<>PSM中 "
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 63, 64, 65, 200, 1000]))), "en") for i in range(400)]
    rows += [(500 + i, "x<P>y", None) for i in range(20)] + [(530 + i, "<<<SS>>MM<<P", "en") for i in range(20)] + [(None, "no id", "en"), (None, None, None), (600, None, None), (601, "", ""), (600, "again", "")]
    return rows + [(700 + i, "é\n😀" * 30_000, "en") for i in range(3)]


def test_fim(spark):
    rows = _fim_rows()
    got = op13.transform(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("mine")))
    assert got.columns == ["doc_id", "text", "lang", "n", "n_", "form", "prefix_chars", "middle_chars", "output"]
    done = got.withColumn("back", op13.restore(F.col("output"), F.col("form"))).collect()
    assert len(done) == len(rows) and all(r.n == "mine" for r in done)
    for r in done:
        assert (r.n_, r.form, r.prefix_chars, r.middle_chars, r.output) == slow_fim(r.doc_id, r.text) and r.back == (r.text or "")
    assert {r.form for r in done} == {"plain", "psm", "spm"}


def test_runs_give_the_offsets_of_points():
    """Runs of several code points and single ones are one thing: lengths and offsets agree with Python's own indices."""
    for text in ("", "a", "é😀\n" * 50, "x" * 64, "x" * 65, "\r\n" * 70_000):
        for block in (1, 64):
            units = op13.Units(block)
            assert units.read(text) == len(text)
            assert all(units.offset(k) == k for k in {0, len(text) // 2, max(len(text) - 1, 0), len(text)})


def test_fim_sql(spark, tmp_path):
    rows = [r for r in _fim_rows() if "\x00" not in (r[1] or "")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert as_counter(op13.op13_fim(spark, str(tmp_path))) == by_sql(op13.ORACLE_SQL, rows)
    assert op13.transform(spark.createDataFrame([], DOCS)).count() == 0
