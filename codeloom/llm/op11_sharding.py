"""Shards of near-equal bytes by a minimax contiguous partition, in native expressions only.

Equal texts are never parted. Groups of them are put in order by a hash of the text and taken together in ``CELLS`` cells of that
order, the atomic units: as many at any input, so that their sizes fit one row. A binary search finds the smallest capacity
at which a greedy pass over the sizes in order needs no more than the shards; then the order is cut. Greedy cuts at
that capacity would leave what is over to the last shard, so a cut goes where its shard is nearest to the mean of what is left, as
long as no shard exceeds the capacity and the rest still fits (a greedy pass from the end tells where it does). A cell that is
larger than the mean of what is left comes first in the order and has a shard of its own, so one group with a third of all bytes doesn't
set the capacity of the others.

A text leaves its scan as a digest. Slots are counted in three levels, so no window holds more than some thousands of rows: a cell's
begin in its shard, a bucket's in its cell and a row's in its bucket. Rows that repeat id and text are counted before anything
moves and dealt to buckets in chunks, so one row a million times is split as well.

Defined cases: a null text is an empty one, of size 1 and CRC 0; a null ``doc_id`` is a value of its own; repeated rows each have a
slot; with fewer cells than shards some shards are empty; other columns are left to :func:`with_shards`; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, let

SHARDS = 16
#: Atomic units of the order, a power of 4 up to 16**4.
CELLS = 1 << 14
#: Rows in a bucket on average, and at most in a chunk of repeated rows.
BUCKET = 4096


def _hex(text: Column, n: int) -> Column:
    return F.conv(F.substring(text, 1, n), 16, 10).cast("long")


def _cell(digest: Column) -> Column:
    return F.floor(_hex(digest, 4) / (65536 // CELLS)).cast("int")


def _long(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("long")


def _smallest_capacity(sizes: Column, shards: Column) -> Column:
    """The smallest capacity at which the sizes, taken in order, fill no more than ``shards``."""
    whole, largest = F.aggregate(sizes, _long(0), lambda a, x: a + x), F.coalesce(F.array_max(sizes), _long(0))
    least = F.greatest(F.ceil(whole / shards).cast("long"), largest)

    def fits(capacity: Column) -> Column:
        def put(s: Column, x: Column) -> Column:
            more = s["fill"] + x > capacity
            return F.struct(F.when(more, s["used"] + 1).otherwise(s["used"]).alias("used"), F.when(more, x).otherwise(s["fill"] + x).alias("fill"))

        return F.aggregate(sizes, F.struct(_long(1).alias("used"), _long(0).alias("fill")), put, lambda s: s["used"] <= shards)

    def halve(b: Column, _: Column) -> Column:
        middle = F.shiftright(b["low"] + b["high"], 1)
        tried = let(fits(middle), lambda ok: F.struct(F.when(ok, b["low"]).otherwise(middle + 1).alias("low"), F.when(ok, middle).otherwise(b["high"]).alias("high")))
        return F.when(b["low"] < b["high"], tried).otherwise(b)

    # Every shard but the last is filled to more than capacity less the largest, so mean and largest together always do.
    return let(F.struct(least.alias("low"), (least + largest).alias("high")), lambda b: F.aggregate(F.sequence(F.lit(1), F.lit(62)), b, halve, lambda x: x["low"]))


def _starts_from_the_end(sizes: Column, capacity: Column) -> Column:
    """At q: the least index from where q shards of the capacity hold the rest."""

    def put(s: Column, x: Column) -> Column:
        more = s["fill"] + x > capacity
        return F.struct(
            F.when(more, x).otherwise(s["fill"] + x).alias("fill"), (s["at"] - 1).alias("at"),
            F.when(more, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"),
        )

    zero = F.struct(_long(0).alias("fill"), F.size(sizes).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    return F.aggregate(F.reverse(sizes), zero, put, lambda s: s["starts"])


def _cuts(sizes: Column, shards: Column, capacity: Column) -> Column:
    """The indices at which the second and later shards begin."""
    whole = F.aggregate(sizes, _long(0), lambda a, x: a + x)

    def parted(whole: Column, starts: Column) -> Column:
        def put(s: Column, x: Column) -> Column:
            left = shards - F.size(s["cuts"])
            fits = F.coalesce(F.get(starts, left - 2), _long(0)) <= s["at"]
            near = (2 * s["fill"] + x) * left > 2 * (whole - s["done"])
            close = (s["fill"] + x > capacity) | ((s["fill"] > 0) & (left > 1) & fits & near)
            return let(close, lambda c: F.struct(
                F.when(c, x).otherwise(s["fill"] + x).alias("fill"), F.when(c, s["done"] + s["fill"]).otherwise(s["done"]).alias("done"),
                (s["at"] + 1).alias("at"), F.when(c, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"),
            ))

        zero = F.struct(_long(0).alias("fill"), _long(0).alias("done"), _long(0).alias("at"), F.array().cast("array<bigint>").alias("cuts"))
        return F.aggregate(sizes, zero, put, lambda s: s["cuts"])

    return let(whole, lambda w: let(_starts_from_the_end(sizes, capacity), lambda st: parted(w, st)))


def partition(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(cell, size, n, shard)`` from ``(cell, size, n)``, at most some ten thousands of rows: the cells in order, cut."""
    cell = F.struct("cell", "size", "n")
    one = groups.agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("whole"))
    first = F.slice(F.sort_array(F.transform("cells", lambda c: F.struct(c["size"].alias("size"), (-c["cell"]).alias("minus"))), asc=False), 1, shards - 1)

    def giant(s: Column, x: Column) -> Column:
        large = x["size"] * (shards - F.size(s["own"])) > s["rest"]
        return F.when(large, F.struct((s["rest"] - x["size"]).alias("rest"), F.concat(s["own"], F.array(-x["minus"])).alias("own"))).otherwise(s)

    own = F.aggregate(first, F.struct(F.col("whole").alias("rest"), F.array().cast("array<int>").alias("own")), giant, lambda s: s["own"])
    one = cut(one.select("cells", own.alias("own")))
    rest = F.filter("cells", lambda c: ~F.array_contains(F.col("own"), c["cell"]))
    one = cut(one.select("cells", "own", rest.alias("rest"), F.transform(rest, lambda c: c["size"]).alias("sizes"), (shards - F.size("own")).alias("left")))
    cuts = let(_smallest_capacity(F.col("sizes"), F.col("left")), lambda c: _cuts(F.col("sizes"), F.col("left"), c))
    one = cut(one.select("own", "rest", "cells", cuts.alias("cuts")))
    ordered = F.transform("rest", lambda c, i: F.struct(c.alias("c"), (F.size("own") + F.size(F.filter("cuts", lambda x: x <= i))).alias("shard")))
    alone = F.transform("own", lambda c, i: F.struct(F.filter("cells", lambda x: x["cell"] == c)[0].alias("c"), i.alias("shard")))
    got = one.select(F.explode(F.concat(alone, ordered)).alias("x"))
    return got.select("x.c.cell", "x.c.size", "x.c.n", "x.shard")


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    got = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.md5(raw).alias("digest"))
    return got.withColumn("cell", _cell(F.col("digest")))


def _by_cell(rows: DataFrame, shards: int) -> DataFrame:
    return cut(partition(rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), shards))


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row."""
    rows = cut(_texts(docs, text, doc_id))
    plan = _by_cell(rows, shards)
    base = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    plan = plan.select(F.col("cell").alias("its"), "shard", base.alias("base"), F.greatest(F.ceil(F.col("n") / BUCKET), F.lit(1)).cast("long").alias("buckets"))

    # Entries of equal rows, cut into chunks that are dealt to a cell's buckets. The plan has a row a cell, so it can be broadcast.
    entries = rows.groupBy("cell", "digest", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    entries = entries.withColumn("chunk", F.explode(F.sequence(_long(0), F.floor((F.col("copies") - 1) / BUCKET).cast("long"))))
    entries = entries.withColumn("many", F.least(F.col("copies") - F.col("chunk") * BUCKET, _long(BUCKET)))
    name = F.md5(F.concat_ws(":", "digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("chunk").cast("string")))
    entries = entries.join(F.broadcast(plan), F.col("cell") == F.col("its")).withColumn("bucket", F.pmod(_hex(name, 12), F.col("buckets")))
    entries = cut(entries.select("cell", "bucket", "shard", "base", "digest", "doc_id", "chunk", "many", "size", "text_crc32"))

    begins = entries.groupBy(F.col("cell").alias("_cell"), F.col("bucket").alias("_bucket")).agg(F.sum("many").alias("_n"))
    begins = begins.withColumn("begin", F.sum("_n").over(Window.partitionBy("_cell").orderBy("_bucket")) - F.col("_n"))
    placed = entries.join(begins, (F.col("cell") == F.col("_cell")) & (F.col("bucket") == F.col("_bucket")))
    line = Window.partitionBy("_cell", "_bucket").orderBy("digest", F.col("doc_id").asc_nulls_first(), "chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("at", F.col("base") + F.col("begin") + F.sum("many").over(line) - F.col("many"))
    slot = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("many") - 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` with the shard of each row after its columns, for writing by shard; no row moves."""
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select((F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) + 1).cast("long").alias("size"), _cell(digest).alias("cell"))
    its, own, shard = fresh(docs, "its"), fresh(docs, "own_cell"), fresh(docs, "shard")
    plan = _by_cell(rows, shards).select(F.col("cell").alias(its), F.col("shard").alias(shard))
    got = docs.withColumn(own, _cell(digest)).join(F.broadcast(plan), F.col(own) == F.col(its))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns], shard)


_FILL = "struct_pack(used := 1::BIGINT, fill := 0::BIGINT)"
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i : list_reduce(range(8), lambda c, k : xor(c >> 1, (c & 1) * 3988292384), i)) AS t
), texts AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS digest,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h : CAST('0x' || h AS BIGINT)),
      lambda c, x : xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, crc_table
), celled AS (
  SELECT *, CAST('0x' || substr(digest, 1, 4) AS INTEGER) // {65536 // CELLS} AS cell FROM texts
), cells AS (
  SELECT cell, CAST(sum(size) AS BIGINT) AS size, count(*) AS n FROM celled GROUP BY cell
), largest AS (
  SELECT cell, size, row_number() OVER (ORDER BY size DESC, cell) AS place,
    (SELECT sum(size) FROM cells) - coalesce(sum(size) OVER (ORDER BY size DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM cells
), alone AS (
  SELECT cell, CAST(place - 1 AS INTEGER) AS shard FROM largest
  WHERE place < {SHARDS} AND place < coalesce((SELECT min(place) FROM largest WHERE size * ({SHARDS} + 1 - place) <= rest), 1000000)
), line AS (
  SELECT list(size ORDER BY cell) AS sizes, CAST(sum(size) AS BIGINT) AS whole, max(size) AS top, {SHARDS} - (SELECT count(*) FROM alone) AS shards
  FROM cells WHERE cell NOT IN (SELECT cell FROM alone)
), search AS (
  SELECT greatest(CAST(ceil(whole / shards) AS BIGINT), top) AS low, greatest(CAST(ceil(whole / shards) AS BIGINT), top) + top AS high FROM line
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE middle + 1 END, CASE WHEN ok THEN middle ELSE high END FROM (
    SELECT low, high, (low + high) // 2 AS middle, list_reduce(sizes, lambda s, x : CASE WHEN s.fill + x > (low + high) // 2
      THEN struct_pack(used := s.used + 1, fill := x) ELSE struct_pack(used := s.used, fill := s.fill + x) END, {_FILL}).used <= shards AS ok
    FROM search, line WHERE low < high)
), capacity AS (
  SELECT min(high) AS c FROM search
), behind AS (
  SELECT list_reduce(list_reverse(sizes), lambda s, x : CASE WHEN s.fill + x > c
    THEN struct_pack(fill := x, at := s.at - 1, starts := list_append(s.starts, s.at)) ELSE struct_pack(fill := s.fill + x, at := s.at - 1, starts := s.starts) END,
    struct_pack(fill := 0::BIGINT, at := len(sizes)::BIGINT, starts := []::BIGINT[])).starts AS starts FROM line, capacity
), cuts AS (
  SELECT list_reduce(sizes, lambda s, x : CASE WHEN s.fill + x > c OR (s.fill > 0 AND len(s.cuts) + 1 < shards AND coalesce(starts[shards - len(s.cuts) - 1], 0) <= s.at
      AND (2 * s.fill + x) * (shards - len(s.cuts)) > 2 * (whole - s.done))
    THEN struct_pack(fill := x, done := s.done + s.fill, at := s.at + 1, cuts := list_append(s.cuts, s.at))
    ELSE struct_pack(fill := s.fill + x, done := s.done, at := s.at + 1, cuts := s.cuts) END,
    struct_pack(fill := 0::BIGINT, done := 0::BIGINT, at := 0::BIGINT, cuts := []::BIGINT[])).cuts AS cuts FROM line, capacity, behind
), sharded AS (
  SELECT cell, n, CAST({SHARDS} - shards + len(list_filter(cuts, lambda x : x <= i)) AS INTEGER) AS shard
  FROM (SELECT cell, n, row_number() OVER (ORDER BY cell) - 1 AS i FROM cells WHERE cell NOT IN (SELECT cell FROM alone)), cuts, line
  UNION ALL SELECT cell, n, shard FROM alone JOIN cells USING (cell)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY digest, doc_id) - 1 AS copy FROM celled
), dealt AS (
  SELECT d.*, shard, CAST('0x' || substr(md5(concat(digest, ':', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', copy // {BUCKET})), 1, 12) AS BIGINT)
    % greatest(1, CAST(ceil(n / {BUCKET}) AS BIGINT)) AS bucket
  FROM numbered d JOIN sharded USING (cell)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, bucket, digest, doc_id NULLS FIRST, copy) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, digest, shard and slot."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
