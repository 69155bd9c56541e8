"""Mixing sources to target weights by Sainte-Laguë apportionment, in native expressions only.

A source's target follows from its weight: 150 % of all words are shared by weight, no source gets more
than twice its own words, and what is over goes to the others by weight. The mix is then dealt in
blocks of equally many words: sources are parties, their targets votes, and blocks seats, which go
to the highest quotients target / (2k + 1). A source's blocks are apportioned in the same way to its
shards, groups of documents of bounded number. Inside a shard documents lie end to end in a seeded
order and the quota of blocks is taken from a seeded block on, wrapping around, so a document
counts twice at most.

Highest quotients need no list of all quotients: with ``H`` seats for ``S`` parties and ``V`` votes the
last winning divisor lies between V / (H + S / 2) and V / (H - S / 2), so every party is sure of the seats
that the larger divisor gives and only about 2 S quotients are ranked for the rest.

Only (key, source, size) is ordered, never a text. Tables of sources and shards are aggregated first; a source with a third
of all rows is cut into shards by a hash of id and text before anything is ordered, so a null or repeated ``doc_id`` is spread
like others. Rows that repeat id, text and source are one entry with a count; what is taken goes back to the rows by one join.

Defined cases: a null text has no words; a null source is a source of its own, sorted last; a source
without words has the target 0; repeated rows are documents of their own with the same ``taken``; a null
``doc_id`` is ordered by its hash like any other; columns in ``keep`` named like new ones get an underscore; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, n_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 7
#: Documents that a shard holds on average.
SHARD_DOCS = 4_000
#: A block has a 2**20th of the mix, but at most so many words, and at most this part of any target.
BLOCKS = 1 << 20
BLOCK_WORDS = 1024
BLOCK_PART = 64


def targets(sizes: DataFrame, source: str = "source", share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from ``(source, size)`` rows.

    Sources reach their cap in the order of cap / weight. With the first j of them capped, the others
    get ``level`` words a unit of weight; the fewest capped whose next ratio is no less than the level
    is where nothing is over. Ordered windows here run over one row a source.
    """
    by = sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col(source).asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = by.withColumn("weight", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy(F.col("ratio"), F.col(source).asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size")).over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)
    target = F.coalesce(F.least("cap", F.col("weight") * level["level"]), F.col("cap"))
    return ranked.select(source, "source_size", "n_docs", target.alias("target"))


def apportion(parties: DataFrame, votes: str, seats: str, within: list[str], key: list[str], out: str) -> DataFrame:
    """``parties`` with Sainte-Laguë seats: ``seats`` (a column constant within each group) by ``votes``.

    Equal quotients go in the order of ``key``. Groups are bounded: all sources, or one source's shards.
    """
    group = Window.partitionBy(*within)
    v, h = F.col(votes), F.col(seats)
    total, many = F.sum(v).over(group), F.count(F.lit(1)).over(group)
    p = parties.withColumn("_v", total).withColumn("_s", many)
    # Seats that every divisor in question grants, and those that some do.
    sure = F.greatest(F.floor(v * (h - F.col("_s") / 2 - 1) / F.col("_v") + 0.5), F.lit(0))
    may = F.greatest(F.ceil(v * (h + F.col("_s") / 2 + 1) / F.col("_v") + 0.5), F.lit(1))
    some = (F.col("_v") > 0) & (v > 0)
    p = p.withColumn("_sure", F.when(some, sure).otherwise(0).cast("long")).withColumn("_may", F.when(some, may).otherwise(0).cast("long"))
    p = p.withColumn("_left", h - F.sum("_sure").over(group))
    open_to = F.when(F.col("_may") > F.col("_sure"), F.sequence(F.col("_sure"), F.greatest(F.col("_may") - 1, F.col("_sure"))))
    quotients = p.withColumn("_k", F.explode_outer(open_to))
    quotient = (v / (2 * F.col("_k") + 1)).desc_nulls_last()
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(quotient, *[F.col(k).asc_nulls_last() for k in key], "_k"))
    won = F.count_if(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")))
    rest = [F.first(c).alias(c) for c in [*parties.columns, "_sure"] if c not in key]
    got = quotients.withColumn("_rank", rank).groupBy(*key).agg(*rest, won.alias("_won"))
    return got.select(*parties.columns, (F.col("_sure") + F.col("_won")).alias(out))


def _hex(text: Column, at: int, n: int = 12) -> Column:
    return F.conv(F.substring(text, at, n), 16, 10).cast("long")


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    """What a row is ordered and dealt by: rows that repeat neither id nor text go apart, and equal rows can be counted first."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in (doc_id, F.md5(text))]
    return F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1]))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, shard_docs: int = SHARD_DOCS, blocks: int = BLOCKS, keep: Sequence[str] = ()
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every document, then its columns ``keep``."""
    key = _key(F.col(doc_id), F.col(text), seed)
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), key.alias("_key")))
    goal = targets(sized)
    everything = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.least(F.ceil(F.sum("target").over(everything) / F.lit(blocks)), F.lit(BLOCK_WORDS), F.floor(least / BLOCK_PART))
    block = F.greatest(block, F.lit(1)).cast("long")
    goal = goal.withColumn("block", block).withColumn("seats", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
    goal = apportion(goal, "target", "seats", [], ["source"], "quota")
    goal = cut(goal.withColumn("shards", F.ceil(F.col("n_docs") / shard_docs).cast("long")))

    # Rows that repeat id, text and source are one entry, counted before anything moves.
    keyed = sized.groupBy("_key", "source").agg(F.first("size").alias("one"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.col("one") * F.col("copies"))
    keyed = keyed.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    keyed = keyed.withColumn("shard", F.pmod(_hex(F.col("_key"), 1), F.col("shards")))
    shards = keyed.groupBy("_source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"), F.first("block").alias("block"))
    shards = apportion(shards, "shard_size", "quota", ["_source"], ["_source", "shard"], "take")
    n = F.greatest(F.ceil(F.col("shard_size") / F.col("block")), F.lit(1)).cast("long")
    offset = F.pmod(_hex(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("_source", F.lit("")), F.col("shard"))), 1), n)
    shards = shards.select(F.col("_source").alias("_own"), F.col("shard").alias("_shard"), "shard_size", n.alias("n"), F.least(F.col("take"), MOST * n).alias("take"), offset.alias("offset"))

    placed = keyed.join(shards, F.col("_source").eqNullSafe(F.col("_own")) & (F.col("shard") == F.col("_shard")))
    line = Window.partitionBy("_own", "_shard").orderBy("_key")
    placed = placed.withColumn("start", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.withColumn("stop", F.col("start") + F.col("size"))
    whole, rest = F.expr("take div n"), F.expr("take % n")
    low = F.col("offset") * F.col("block")
    high = (F.col("offset") + rest) * F.col("block")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least(F.col("stop"), b) - F.greatest(F.col("start"), a), F.lit(0))

    # Blocks past the last one wrap around to the shard's first.
    wrapped = overlap(F.lit(0), (F.col("offset") + rest - F.col("n")) * F.col("block"))
    taken = whole * F.col("size") + overlap(low, F.least(high, F.col("n") * F.col("block"))) + wrapped
    # Copies share what is taken of their entry, to the nearest word.
    each = F.floor((2 * taken + F.col("copies")) / (2 * F.col("copies"))).cast("long")
    plan = placed.select(F.col("_key").alias("_its"), F.col("source").alias("_from"), "source_size", "target", F.col("one").alias("_size"), each.alias("taken"))
    if not keep:
        rows = sized.select("_key", "doc_id", "source", "size")
    else:
        rows = docs.select(key.alias("_key"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *[F.col(f"`{c}`").alias(f"_keep{k}") for k, c in enumerate(keep)])
        plan = plan.withColumnRenamed("_size", "size")
    got = rows.join(plan, (F.col("_key") == F.col("_its")) & F.col("source").eqNullSafe(F.col("_from")))
    own = ("doc_id", "source", "size", "source_size", "target", "taken")
    last = [F.col(f"_keep{k}").alias(f"{c}_" if c.lower() in own else c) for k, c in enumerate(keep)]
    return got.select(*own, *last)


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS key FROM documents
), entries AS (
  SELECT key, source, CAST(any_value(size) * count(*) AS BIGINT) AS size, count(*) AS copies FROM sized GROUP BY key, source
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM by_source
), ranked AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
  FROM weighed WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size, n_docs, least(cap, weight * (SELECT arg_min(level, ratio) FROM ranked WHERE ratio >= level)) AS target FROM ranked
), blocked AS (
  SELECT *, CAST(greatest(1, least(ceil(sum(target) OVER () / {BLOCKS}), {BLOCK_WORDS}, floor(min(CASE WHEN target > 0 THEN target END) OVER () / {BLOCK_PART}))) AS BIGINT) AS block,
    CAST(ceil(n_docs / {SHARD_DOCS}) AS BIGINT) AS shards FROM goal
), quotas AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS place, round(sum(DISTINCT whole) OVER () / block) AS seats FROM (
      SELECT source, target, block, unnest(generate_series(0, CAST(target / block AS BIGINT) + 2)) AS k, whole
      FROM (SELECT *, sum(target) OVER () AS whole FROM blocked) WHERE target > 0)
  ) WHERE place <= seats GROUP BY source
), keyed AS (
  SELECT s.*, b.source_size, b.target, b.block, coalesce(q.quota, 0) AS quota, CAST('0x' || substr(s.key, 1, 12) AS BIGINT) % b.shards AS shard
  FROM entries s JOIN blocked b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), shard_sizes AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(quota) AS quota, any_value(block) AS block FROM keyed GROUP BY ALL
), takes AS (
  SELECT source, shard, count(*) AS take FROM (
    SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place FROM (
      SELECT *, unnest(generate_series(0, CAST(quota * shard_size / greatest(sum(shard_size) OVER (PARTITION BY source), 1) AS BIGINT) + 2)) AS k FROM shard_sizes)
    WHERE shard_size > 0) WHERE place <= quota GROUP BY ALL
), shard_plan AS (
  SELECT z.source, z.shard, greatest(1, CAST(ceil(z.shard_size / z.block) AS BIGINT)) AS n, coalesce(t.take, 0) AS wanted,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(z.source, '') || ':' || z.shard), 1, 12) AS BIGINT) AS seeded
  FROM shard_sizes z LEFT JOIN takes t ON z.source IS NOT DISTINCT FROM t.source AND z.shard = t.shard
), placed AS (
  SELECT k.*, p.n, least(p.wanted, 2 * p.n) // p.n AS whole, least(p.wanted, 2 * p.n) % p.n AS rest, p.seeded % p.n AS first,
    CAST(sum(k.size) OVER (PARTITION BY k.source, k.shard ORDER BY k.key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM keyed k JOIN shard_plan p ON k.source IS NOT DISTINCT FROM p.source AND k.shard = p.shard
)
SELECT d.doc_id, d.source, d.size, p.source_size, p.target, CAST((2 * (whole * p.size
    + greatest(0, least(stop, least(first + rest, n) * block) - greatest(stop - p.size, first * block))
    + greatest(0, least(stop, (first + rest - n) * block) - (stop - p.size))) + copies) // (2 * copies) AS BIGINT) AS taken
FROM placed p JOIN sized d ON d.key = p.key AND d.source IS NOT DISTINCT FROM p.source
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target and the words that the mix takes of it."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
