"""Chat formatting: logged snapshots collapse into maximal conversations, which are then rendered.

A chat log often holds a conversation once per reply, each snapshot a prefix of the next. Turn k of a
conversation has a hash of its position and content; the rolling hash of the first k turns is the
exclusive-or of these, 120 bits in two longs. A conversation whose whole hash is another's hash of
proper prefix is a snapshot, and an anti-join drops it; of equal conversations the smallest
``conv_id`` stays. Only the maximal ones are rendered.

Order and rolling hashes take two levels, blocks of turns and turns of a block, so a conversation with a
third of all rows is spread over tasks; so is its rendering, in parts of at most ``PART`` turns (part 0, 1, ...
are concatenated; nearly every conversation has just part 0). A block of many turns (without a number, or of one number)
is parted further by turn and hash. Hashes move first; texts move once, those of maximal conversations only.

Defined cases: turns go by ``turn`` (null first), ties by a hash of role and text; a repeated row is one turn;
null roles and texts count as empty; rows with a null ``conv_id`` are one conversation; the
template's markers inside a text are broken up by a space; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Turns of a block (by turn number) and of a rendered part.
BLOCK = 256
PART = 256
#: A block of more turns than this is parted by turn and hash.
SPLIT = 4096


def _long(text: Column, at: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(text, at, 15), 16, 10).cast("long")


def turns(chats: DataFrame) -> DataFrame:
    """``(conv_id, turn, h, pos, p1, p2, n)``: every distinct turn with its place and rolling prefix hash."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keys = chats.select("conv_id", "turn", F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("h")).distinct()
    keys = cut(keys.withColumn("block", F.floor(F.col("turn") / BLOCK)))
    large = keys.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > SPLIT)
    large = cut(large.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.lit(True).alias("large")))
    # In the order of turn and hash: three digits of the turn within its block, then of the hash.
    finer = F.concat(F.lpad(F.coalesce(F.col("turn") - F.col("block") * BLOCK, F.lit(0)).cast("string"), 3, "0"), F.substring("h", 1, 3))
    keys = keys.join(large, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left")
    keys = keys.select("conv_id", "turn", "h", "block", F.when(F.col("large"), finer).otherwise("").alias("sub"))
    by = ("conv_id", "block", "sub")
    inside = Window.partitionBy(*by).orderBy(F.col("turn").asc_nulls_first(), "h")
    so_far = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first(), "sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.col("sub").alias("s"),
        F.coalesce(F.sum("k").over(so_far), F.lit(0)).alias("before"),
        F.sum("k").over(Window.partitionBy("conv_id")).alias("n"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")) & (F.col("sub") == F.col("s"))
    placed = keys.withColumn("row", F.row_number().over(inside)).join(cut(sizes), same).drop("c", "b", "s")
    placed = placed.withColumn("pos", F.col("before") + F.col("row"))
    mixed = F.md5(F.concat_ws(":", "pos", "h"))
    placed = cut(placed.withColumn("x1", _long(mixed, 1)).withColumn("x2", _long(mixed, 16)))
    totals = placed.groupBy(*by).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    zero = F.lit(0).cast("long")
    totals = totals.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("sub").alias("s"), *[F.coalesce(F.bit_xor(x).over(so_far), zero).alias(f"{x}_before") for x in ("x1", "x2")]
    )
    rolled = placed.join(cut(totals), same).drop("c", "b", "s")
    for x, p in (("x1", "p1"), ("x2", "p2")):
        rolling = F.bit_xor(x).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rolled = rolled.withColumn(p, rolling.bitwiseXOR(F.col(f"{x}_before")))
    return rolled.select("conv_id", "turn", "h", "pos", "p1", "p2", "n")


def maximal(placed: DataFrame) -> DataFrame:
    """``(conv_id)`` of the conversations that are no proper prefix of another, one of equal ones."""
    whole = placed.where("pos = n").select("conv_id", "n", "p1", "p2")
    prefixes = placed.where("pos < n").select(F.col("pos").alias("n"), "p1", "p2").distinct()
    kept = whole.join(prefixes, ["n", "p1", "p2"], "left_anti")
    return kept.groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id")).select("conv_id")


def render(role: Column, text: Column) -> Column:
    """One turn in the markup of chat models."""

    def plain(c: Column) -> Column:
        return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_")), F.lit("|>"), F.lit("| >"))

    return F.concat(F.lit("<|im_start|>"), plain(role), F.lit("\n"), plain(text), F.lit("<|im_end|>\n"))


def collapse(chats: DataFrame, part: int = PART) -> DataFrame:
    """``(conv_id, part, n_turns, rendered)`` of the maximal conversations; ``n_turns`` of the whole conversation."""
    chats = chats.select("conv_id", "turn", "role", "text")
    placed = cut(turns(chats))
    kept = maximal(placed).withColumnRenamed("conv_id", "k")
    placed = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("k")), "left_semi")
    placed = placed.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("h").alias("g"), "pos", "n")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = chats.withColumn("h", F.md5(F.concat(F.length(role), F.lit(":"), role, text)))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("h") == F.col("g"))
    shown = said.join(placed, same).select(
        "conv_id", F.floor((F.col("pos") - 1) / part).alias("part"), "n", F.struct("pos", render(F.col("role"), F.col("text")).alias("shown")).alias("turn")
    )
    # A set, since repeated rows are one turn.
    lines = F.transform(F.array_sort(F.collect_set("turn")), lambda x: x["shown"])
    return shown.groupBy("conv_id", "part").agg(F.max("n").alias("n_turns"), F.array_join(lines, "").alias("rendered"))


ORACLE_SQL = f"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), hashed AS (
  SELECT *, md5(concat(length(role), ':', role, text)) AS h FROM said
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM hashed
), rolled AS (
  SELECT *, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM placed
), whole AS (
  SELECT * FROM rolled WHERE pos = n
), kept AS (
  SELECT min(conv_id) AS conv_id FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.pos < r.n AND r.prefix = w.prefix) GROUP BY prefix
)
SELECT conv_id, (pos - 1) // {PART} AS part, max(n) AS n_turns,
  string_agg(concat('<|im_start|>', replace(replace(role, '<|im_', '<| im_'), '|>', '| >'), chr(10),
    replace(replace(text, '<|im_', '<| im_'), '|>', '| >'), '<|im_end|>', chr(10)), '' ORDER BY pos) AS rendered
FROM placed WHERE EXISTS (SELECT 1 FROM kept k WHERE k.conv_id IS NOT DISTINCT FROM placed.conv_id) GROUP BY ALL
"""


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
