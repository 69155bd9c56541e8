"""The whole analysis of a table of files, one row a file from the first layer to the last, then one row an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import barrier
from ..operators import agents, edits, language, matching, report, risk, rollup, scan, structure, testruns
from ..sources.tables import written


def layers(files: DataFrame) -> DataFrame:
    """``files(analysis_id, file_idx, path, content)`` through all layers; nothing but the last aggregations shuffles.

    A file of unknown language or without issues stops where it does in a run: its later columns are null (FLT-10). Rows are written
    after the costly layers, as each would otherwise be planned, and partly worked out, again for every layer and result after it.
    """
    df = language.detect(files)
    known = F.col("language") != "Unknown"
    df = written(scan.file_scan(structure.parse(df)), "scanned")
    df = agents.rule_issues(df)
    df = df.withColumn("issues", F.when(known, F.col("issues")))
    df = written(agents.rule_changes(df), "proposed")
    going = known & (F.size("issues") > 0)
    df = df.withColumn("changes", F.when(going, F.col("changes")))
    validated = F.filter("changes", lambda c: c["status"] == "validated")
    df = edits.modernise(df.withColumn("_valid", validated), changes="_valid")
    df = written(df.withColumn("diff_result", F.when(going, F.col("diff_result"))), "edited")
    modified = F.coalesce("diff_result.modified_file", "content")
    df = df.withColumn("_after", F.struct(F.col("path"), modified.alias("content"), F.col("language")))
    parsed = barrier(F.pandas_udf(structure._parse_batch, dict(df.dtypes)["ast"]))(modified, language.parser_key(F.col("language")))
    tested = F.when(going, testruns.run(F.col("language"), F.col("content"), modified))
    df = df.withColumns({"modified_ast": parsed, "test_result": tested})  # one Python worker a task for both
    df = df.withColumn("validation", F.when(going, edits.validate(F.col("ast"), F.col("modified_ast"))))
    df = df.withColumn("validated_changes", testruns.unless_regression(F.col("changes"), F.col("test_result.regression_detected")))
    df = df.withColumn("risk_result", F.when(going, risk.assess(F.col("changes"), F.col("test_result.regression_detected"))))
    return written(df.drop("_valid", "_after"), "done")


def evaluated(done: DataFrame, golden: DataFrame) -> DataFrame:
    """``(analysis_id, file_idx, confidence_score)`` of files with changes."""
    rows = done.select("analysis_id", "file_idx", "language", F.explode("changes").alias("c"))
    rows = rows.select("analysis_id", "file_idx", "language", "c.ord", "c.issue_type", "c.old_code", "c.new_code", "c.status")
    return matching.confidence(rows, golden, ("analysis_id", "file_idx"))


def analyse(files: DataFrame) -> dict[str, DataFrame]:
    """Files, changes to store and analyses, as three DataFrames."""
    done = layers(files)
    scored = done.join(evaluated(done, matching.golden(files.sparkSession)), ["analysis_id", "file_idx"], "left")
    results = scored.select(
        "analysis_id", "file_idx", "language", "era", F.when(F.col("issues").isNotNull(), F.size("issues")).alias("n_issues"), F.size("security_findings").alias("n_findings"),
        F.col("diff_result.minimality_score").alias("minimality_score"), F.col("complexity_before.avg_cyclomatic").alias("avg_complexity"), "confidence_score",
        F.col("risk_result.estimated_hours_saved").alias("hours_saved"), F.col("test_result.regression_detected").alias("regression"),
        F.col("test_result.modified_results.passed").alias("tests_passed"), F.col("risk_result.overall_risk").alias("overall_risk"),
    )
    keys = ("analysis_id", "file_idx")
    rows = done.select(*keys, F.col("path").alias("file_path"), F.explode("changes").alias("c")).select(*keys, "file_path", "c.*").withColumns({"description": F.col("reason"), "priority": F.lit(2)})
    each = done.select(*keys, F.posexplode("risk_result.per_change_risk").alias("ord", "r")).select(*keys, "ord", "r.*")
    return {"files": scored, "changes": rollup.saved_changes(risk.with_risk(rows, each, keys)), "analyses": rollup.complete(done, results)}


def evidence(scored: DataFrame, timestamp: str) -> DataFrame:
    """The evidence record of every file (PRJ-8) and its report (AGT-14)."""
    d, r, t = F.col("diff_result"), F.col("risk_result"), F.col("test_result")
    e = F.struct(
        F.col("analysis_id"), F.lit(timestamp).alias("timestamp"), F.col("path").alias("source"), F.col("language"), F.col("era"), F.size("issues").alias("issues_found"),
        d["changes_applied"].alias("changes_proposed"), d["changes_rejected"].alias("changes_rejected"), d["minimality_score"].alias("minimality_score"),
        d["lines_changed"].alias("lines_changed"), d["total_lines"].alias("total_lines"), r["overall_risk"].alias("overall_risk"), r["overall_score"].alias("overall_score"),
        r["modernization_readiness"].alias("modernization_readiness"), r["estimated_hours_saved"].alias("estimated_hours_saved"), r["risk_summary"].alias("risk_summary"),
        F.col("confidence_score"), t["framework_detected"].alias("framework_detected"), t["modified_results"]["passed"].alias("tests_passed"),
        t["modified_results"]["failed"].alias("tests_failed"), t["regression_detected"].alias("regression_detected"),
        F.col("security_gate_passed"), F.col("risk_summary.high").alias("security_high"), F.col("risk_summary.medium").alias("security_medium"),
        F.slice("security_findings", 1, 5).alias("security_findings"), F.col("secrets_found").alias("secrets"), F.col("complexity_before"), F.col("maintainability_index"),
        F.col("validation.issues").alias("validation_issues"), risk.change_summary(F.col("changes"), r["per_change_risk"]).alias("changes_summary"),
    )
    out = scored.where("risk_result is not null").select("analysis_id", "file_idx", e.alias("evidence"))
    return out.withColumn("report", report.report(F.col("evidence")))
