"""Golden rules against proposed changes, and the confidence that follows (SRC-6, JOIN-5, AGG-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from .edits import same_code
from .language import rule_key

ELIGIBLE = ("validated", "manual_required")


def golden(spark: SparkSession, table: dict | None = None) -> DataFrame:
    """``(lang_key, rule_ord, legacy, modern, pattern)`` (SRC-6)."""
    rows = [(k, i, *r) for k, rs in (rules.GOLDEN if table is None else table).items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "lang_key string, rule_ord int, legacy string, modern string, pattern string")


def matches(changes: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """The first rule that fits each eligible change: ``(*keys, ord, issue_type, pattern, match_type)`` (JOIN-5).

    ``changes(*keys, ord, language, issue_type, old_code, new_code, status)``. A rule fits by both sides'
    text or else by its name. The table of rules is a fixed few dozen rows, so it is broadcast.
    """
    own = changes.where(F.col("status").isin(*ELIGIBLE)).withColumn("lang_key", rule_key(F.col("language")))
    exact = same_code(F.col("old_code"), F.col("legacy")) & same_code(F.col("new_code"), F.col("modern"))
    fits = own.join(F.broadcast(table), "lang_key").where(exact | (F.col("issue_type") == F.col("pattern")))
    first = F.min_by(F.struct("issue_type", "pattern", F.when(exact, "exact").otherwise("pattern_name").alias("match_type")), "rule_ord")
    return fits.groupBy(*keys, "ord").agg(first.alias("m")).select(*keys, "ord", "m.*")


def confidence(changes: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """``(*keys, total_changes, pattern_matches, confidence_score)`` (AGG-17): 75 without rules, 100 without eligible changes."""
    found = matches(changes, table, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("pattern_matches"))
    ruled = F.array(*[F.lit(k) for k in sorted({r["lang_key"] for r in table.select("lang_key").distinct().collect()})])
    by = changes.groupBy(*keys).agg(F.count_if(F.col("status").isin(*ELIGIBLE)).alias("total_changes"), F.count(F.lit(1)).alias("all_changes"), F.first(F.array_contains(ruled, rule_key(F.col("language")))).alias("has_rules"))
    out = by.join(found, list(keys), "left").withColumn("pattern_matches", F.when(F.col("has_rules"), F.coalesce("pattern_matches", F.lit(0))).otherwise(0))
    share = (F.try_divide(F.col("pattern_matches"), F.col("total_changes")) * 100).cast("int")
    score = F.when(~F.col("has_rules"), 75).when(F.col("total_changes") == 0, 100).otherwise(F.greatest(F.lit(60), share))
    total = F.when(F.col("has_rules"), F.col("total_changes")).otherwise(F.col("all_changes"))
    return out.select(*keys, total.alias("total_changes"), "pattern_matches", score.alias("confidence_score"))


__all__ = ["ELIGIBLE", "confidence", "golden", "matches"]
