"""From files to analyses, and what is stored of changes (AGG-1 to AGG-7, SNK-1 to SNK-3, FLT-4, SET-4, AGG-22, AGG-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .language import breakdown_map

SAVED = ("validated", "manual_required", "validation_failed")


def analyses(results: DataFrame, key: str = "analysis_id") -> DataFrame:
    """One row an analysis from one row a file (AGG-2 to AGG-7); one aggregation by key.

    ``results(key, file_idx, language, era, n_issues, n_findings, minimality_score, avg_complexity, confidence_score,
    hours_saved, regression, tests_passed, overall_risk)``, nulls where a file didn't come so far. Language and era are the
    first file's.
    """
    risk = lambda level: F.count_if(F.col("overall_risk") == level)
    other = F.count_if(F.coalesce(F.col("overall_risk"), F.lit("")) != "")
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.min_by("language", "file_idx").alias("language"),
        F.min_by("era", "file_idx").alias("era"),
        F.sum(F.coalesce("n_issues", F.lit(0))).alias("total_issues"),
        F.sum(F.coalesce("n_findings", F.lit(0))).alias("security_issues"),
        F.round(F.avg("minimality_score"), 2).alias("minimality_score"),
        F.round(F.avg("avg_complexity"), 2).alias("complexity_before"),
        F.round(F.avg("confidence_score"), 2).alias("confidence_score"),
        F.round(F.sum(F.coalesce("hours_saved", F.lit(0.0))), 1).alias("estimated_hours_saved"),
        (~F.coalesce(F.bool_or("regression"), F.lit(False))).alias("tests_passed"),
        F.sum(F.coalesce("tests_passed", F.lit(0))).alias("test_count"),
        F.when(risk("HIGH") > 0, "HIGH").when(risk("MEDIUM") > 0, "MEDIUM").when(other > 0, "LOW").alias("overall_risk"),
    )


def complete(files: DataFrame, results: DataFrame) -> DataFrame:
    """:func:`analyses` with the language breakdown of all files (AGG-1, SNK-3)."""
    return analyses(results).join(breakdown_map(files), "analysis_id", "left")


def saved_changes(assessed: DataFrame) -> DataFrame:
    """Rows to store of changes with their risk (SNK-2): only the saved statuses, with defaults."""
    kept = assessed.where(F.col("status").isin(*SAVED))
    return kept.withColumns(
        {
            "description": F.coalesce(F.nullif("reason", F.lit("")), F.nullif("description", F.lit("")), F.lit("")),
            "risk_level": F.coalesce("risk_level", F.lit("MEDIUM")),
            "priority": F.coalesce("priority", F.lit(2)),
        }
    )


def first_issues(issues: DataFrame, keys: tuple[str, ...] = ("file_id",), order: str = "ord") -> DataFrame:
    """Issues of all chunks, the first of each type and lines (SET-4)."""
    same = Window.partitionBy(*keys, "issue_type", F.to_json(F.struct("affected_lines"))).orderBy(order)
    return issues.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def status_counts(changes: DataFrame, keys: tuple[str, ...] = ("analysis_id",)) -> DataFrame:
    """Accepted, pending and pending LOW changes (AGG-23)."""
    pending = F.col("status") == "pending"
    return changes.groupBy(*keys).agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(pending).alias("pending"), F.count_if(pending & (F.col("risk_level") == "LOW")).alias("pending_low")
    )


def severity_counts(findings: Column) -> Column:
    """Badge counts of a file's findings (AGG-22)."""
    count = lambda s: F.size(F.filter(findings, lambda x: x["severity"] == s))
    return F.struct(count("HIGH").alias("high"), count("MEDIUM").alias("medium"), count("LOW").alias("low"))
