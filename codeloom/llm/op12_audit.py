"""Audit of filters that run one after the other: what each removes in every order, and its Shapley value.

Every document gets a mask of the filters that it fails. The masks' counts aren't aggregated as such, but as signed parity sums
(the Walsh-Hadamard transform): for each of the 32 sets of filters the sum of (-1)^(failed filters in the set), by part, over
all documents, the good and the toxic ones. One aggregation with map-side combining does, of as many rows as there are parts. The
transform is its own inverse but for a factor of 32, so the masks' exact counts come back by 32 signed sums divided by 32. All
else is arithmetic on 32 counts a part: what an order removes at a step are the masks that fail its filter and none before; over
all 120 orders a mask of f failed filters is removed by each of them equally often, so a filter's Shapley value sums
120 / f over the masks that hold it.

A text leaves its scan as a 16-byte digest and a mask. The smallest doc_id of each digest is aggregated first and joined back, the
labels are one row a document; both joins have unique keys on one side, so a text or id with a third of all rows is split.

Defined cases: a null text is empty; a null part is the empty string; a row without a ``doc_id`` has no label and is no copy, nor
is another row its copy; rows that repeat the smallest doc_id of a text are no copies; several labels of one document are
joined (any that says so); extra columns are ignored; an empty table has no parts.
"""

from __future__ import annotations

import re
from hashlib import md5
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_rows, words

FILTERS = "ABCDE"
MEASURES = ("docs", "good", "toxic")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_ODD = re.compile(rb"[#$%&*|]")


def _failures(texts: list[str | None]) -> list[pa.Array]:
    """The mask of filters A to D that each text fails, and the text's digest."""
    masks, digests = [], []
    for text in texts:
        text = text or ""
        raw, found = text.encode(), words(text)
        n, capitals = len(found), len(raw) - len(raw.translate(None, _CAPITALS))
        fails = (n < 100, 100 * len(set(found)) < 80 * n, 100 * capitals > 10 * len(text), _ODD.search(raw) is not None)
        masks.append(sum(1 << k for k, f in enumerate(fails) if f))
        digests.append(md5(raw, usedforsecurity=False).digest())
    return [pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]


def judged(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(part, mask, good, toxic)`` for every document: bit k of the mask is set where filter k of ``FILTERS`` fails."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text"))
    rows = cut(map_rows(src, "text", [("mask", T.IntegerType()), ("digest", T.BinaryType())], _failures, keep=["doc_id", "part"]))
    firsts = rows.groupBy(F.col("digest").alias("its")).agg(F.min("doc_id").alias("first"))
    says = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled"))
    says = says.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    got = rows.join(firsts, F.col("digest") == F.col("its")).select("part", "doc_id", (F.col("mask") + copy).alias("mask"))
    got = got.join(says, F.col("doc_id") == F.col("labelled"), "left")
    return got.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _sign(mask: Column, subset: int) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(subset))) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """``(part, docs, good, toxic)`` with an array of 32 signed parity sums each."""
    mask, size = F.col("mask"), 1 << len(FILTERS)
    of = {"docs": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.array(*[F.sum(_sign(mask, s) * of[m]).cast("long") for s in range(size)]).alias(m) for m in MEASURES]
    return rows.groupBy("part").agg(*sums)


def cells(sums: DataFrame) -> DataFrame:
    """The same with the documents of each of the 32 masks: the transform once more, divided by 32."""
    size = 1 << len(FILTERS)

    def back(m: str) -> Column:
        return F.array(*[F.expr(" ".join(f"{'-' if (mask & s).bit_count() % 2 else '+'} {m}[{s}]" for s in range(size))) for mask in range(size)])

    return sums.select("part", *[F.transform(back(m), lambda x: F.shiftright(x, len(FILTERS))).alias(m) for m in MEASURES])


def orders(counts: DataFrame) -> DataFrame:
    """One row a part, order and step of what the step's filter does."""
    n, whole = len(FILTERS), range(1 << len(FILTERS))
    plan = [("".join(o), k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(f) for f in o[:k])) for o in permutations(FILTERS) for k in range(n)]
    shares = [120 // mask.bit_count() if mask else 0 for mask in whole]
    step = "struct<filter_order:string,step:int,bit:int,before:int>"
    steps = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{k},"bit":{b},"before":{p}}}' for o, k, b, p in plan) + "]"), f"array<{step}>")
    masks = F.sequence(F.lit(0), F.lit(len(whole) - 1))
    rows = counts.withColumn("s", F.explode(steps))
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(measure: str, holds, weigh=None) -> Column:
        def one(mask: Column) -> Column:
            count = F.element_at(F.col(measure), mask + 1)
            return F.when(holds(mask), count * weigh(mask) if weigh else count).otherwise(0)

        return F.aggregate(F.transform(masks, one), F.lit(0).cast("long"), lambda a, x: a + x)

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(bit) != 0

    def came(mask: Column) -> Column:
        return mask.bitwiseAND(before) == 0

    share = F.array(*[F.lit(x) for x in shares])
    out = {
        "kept": total("docs", lambda m: came(m) & ~fails(m)),
        "removed": total("docs", lambda m: came(m) & fails(m)),
        "redundant": total("docs", lambda m: ~came(m) & fails(m)),
        "unique_fails": total("docs", lambda m: m == bit),
        "good_lost": total("good", lambda m: came(m) & fails(m)),
        "toxic_lost": total("toxic", lambda m: came(m) & fails(m)),
        "shapley": total("docs", fails, lambda m: F.element_at(share, m + 1)),
    }
    return rows.select("part", "s.filter_order", "s.step", *[c.alias(k) for k, c in out.items()])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``."""
    return orders(cells(parity_sums(judged(docs, labels, part))))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first FROM texts GROUP BY t
), says AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT x.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len({_WORDS}) < 100, 100 * len(list_distinct({_WORDS})) < 80 * len({_WORDS}), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(x.doc_id > first, false)] AS f
  FROM texts x JOIN firsts USING (t) LEFT JOIN says l ON x.doc_id = l.doc_id
), masks AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 3, 4, 5]) AS i
), plan AS (
  SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), hit AS (
  SELECT part, filter_order, k AS step, n, m.good, m.toxic, f[o[k]] AS fails, list_bool_or(list_transform(range(1, k), lambda j : f[o[j]])) IS TRUE AS gone,
    len(list_filter(f, lambda x : x)) AS fails_n, o[k] AS filter
  FROM masks m, plan, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), removed AS (
  SELECT part, filter, CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS shapley FROM hit GROUP BY ALL
)
SELECT h.part, filter_order, CAST(step AS INTEGER) AS step, CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails AND fails_n = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost, any_value(shapley) AS shapley
FROM hit h JOIN removed r ON h.part = r.part AND h.filter = r.filter GROUP BY h.part, filter_order, step
"""


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters in all orders on every document, by language."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return audit(read("documents").select("doc_id", "text", "lang"), read("labels"))
