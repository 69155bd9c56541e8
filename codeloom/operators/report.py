"""Reports from evidence records: sections, markdown, e-mail (AGT-14, STR-FN-9, PRJ-8, SNK-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colour by risk.
COLOURS = {"LOW": "#22c55e", "MEDIUM": "#f59e0b", "HIGH": "#ef4444"}


# The wording of headings, sentences and table columns in the functions below, as readers of the reports know them.


def _t(value: Column, missing: str = "N/A") -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def _table(rows: Column, head: list[str], row) -> Column:  # noqa: ANN001
    top = F.lit("| " + " | ".join(head) + " |\n|" + "|".join("-" * (len(h) + 2) for h in head) + "|")
    return F.concat(top, F.array_join(F.transform(rows, lambda r: F.concat(F.lit("\n"), row(r))), ""))


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def executive_summary(e: Column) -> Column:
    """Two or three sentences."""
    return F.concat(
        F.lit("Analyzed "), e["source"], F.lit(" ("), e["language"], F.lit(", "), e["era"], F.lit(" era). Found "), _t(e["issues_found"]), F.lit(" legacy issues, "),
        _t(e["changes_proposed"]), F.lit(" changes proposed. Overall risk: "), _t(e["overall_risk"]), F.lit(". "),
        F.when(e["security_gate_passed"], "✅ Security gate passed.").otherwise("⚠️ Security issues found."),
    )


def security_section(e: Column) -> Column:
    """Findings as a table."""
    rows = _table(e["security_findings"], ["Tool", "Severity", "Line", "Issue"], lambda f: _cells(f["tool"], f["severity"], f["line"].cast("string"), f["issue"]))
    return F.when((F.size(e["security_findings"]) == 0) & (F.size(e["secrets"]) == 0), "✅ No security issues detected.").otherwise(rows)


def modernization_section(e: Column) -> Column:
    """Changes as a table."""
    rows = _table(e["changes_summary"], ["Issue", "Risk", "Description"], lambda c: _cells(F.concat(F.lit("`"), c["issue_type"], F.lit("`")), F.concat(F.lit("**"), c["risk"], F.lit("**")), c["reason"]))
    return F.when(F.size(e["changes_summary"]) == 0, "No changes proposed.").otherwise(rows)


def quality_section(e: Column) -> Column:
    """Complexity in one line."""
    c = e["complexity_before"]
    line = F.concat(F.lit("Avg complexity: "), _t(c["avg_cyclomatic"]), F.lit(" | Max: "), _t(c["max_cyclomatic"]), F.lit(" | Maintainability: "), _t(e["maintainability_index"]), F.lit("/100"))
    return F.when(c.isNull(), "Complexity metrics not available (Python only).").otherwise(line)


def markdown(e: Column, product: str = "codeloom") -> Column:
    """The whole report; sections without content are left out."""
    b = lambda label, *rest: F.concat(F.lit(f"- **{label}:** "), *rest, F.lit("\n"))
    head = F.concat(
        F.lit(f"# 🔧 {product} Modernization Report\n**File:** `"), e["source"], F.lit("` | **Language:** "), e["language"], F.lit(" ("), e["era"], F.lit(") | **Analysis:** `"),
        F.left(e["analysis_id"], F.lit(8)), F.lit("`\n**Generated:** "), F.replace(F.substring(e["timestamp"], 1, 19), F.lit("T"), F.lit(" ")), F.lit(" UTC\n\n---\n\n## Executive Summary\n\n- **"),
        _t(e["issues_found"]), F.lit("** legacy patterns detected\n- **"), _t(e["changes_proposed"]), F.lit("** changes proposed ("), _t(e["changes_rejected"]), F.lit(" rejected)\n"),
        b("Minimality score", _t(e["minimality_score"]), F.lit("% of file unchanged")),
        F.lit("- **Overall risk:** "), _t(e["overall_risk"]), F.lit(" | **Confidence:** "), _t(e["confidence_score"]), F.lit("%\n"),
        b("Estimated time saved", _t(e["estimated_hours_saved"], "0"), F.lit(" hours")),
        b("Tests", _t(e["tests_passed"], "0"), F.lit(" passed | Regression: "), F.when(e["regression_detected"], "⚠️ YES — changes blocked").otherwise("✅ None")), F.lit("\n"),
    )
    bad = ~F.coalesce(e["security_gate_passed"], F.lit(True)) | (F.coalesce(e["security_high"], F.lit(0)) > 0)
    warn = "## ⚠️ Security Issues\n\n> **SECURITY ISSUES FOUND — manual review required before modernization**\n\n| Tool | Severity | Line | Issue |\n|------|----------|------|-------|\n"
    finding = lambda f: F.concat(_cells(f["tool"], F.concat(F.lit("**"), f["severity"], F.lit("**")), f["line"].cast("string"), f["issue"]), F.lit("\n"))
    security = F.when(bad, F.concat(F.lit(warn), F.array_join(F.transform(e["security_findings"], finding), ""), F.lit("\n"))).otherwise("")
    change = lambda c: F.concat(
        _cells(F.concat(F.lit("`"), c["issue_type"], F.lit("`")), F.concat(F.lit("`"), c["old_preview"], F.lit("` → `"), c["new_preview"], F.lit("`")), F.concat(F.lit("**"), c["risk"], F.lit("**")), c["reason"]),
        F.lit("\n"),
    )
    top = "## Proposed Changes\n\n| Issue | Change | Risk | Action |\n|-------|--------|------|--------|\n"
    changes = F.when(F.size(e["changes_summary"]) > 0, F.concat(F.lit(top), F.array_join(F.transform(e["changes_summary"], change), ""), F.lit("\n"))).otherwise("")
    c = e["complexity_before"]
    quality = F.when(
        c.isNotNull(),
        F.concat(F.lit("## Code Quality\n\n"), b("Avg cyclomatic complexity", _t(c["avg_cyclomatic"])), b("Max cyclomatic complexity", _t(c["max_cyclomatic"])), b("Maintainability index", _t(e["maintainability_index"])), F.lit("\n")),
    ).otherwise("")
    tail = f"## Rollback\n\n```bash\n# Find all {product} commits\ngit log --oneline | grep '\\[{product}\\]'\n# Revert a specific {product} commit\ngit revert <commit-hash>\n```"
    return F.concat(head, security, changes, quality, F.lit(tail))


def report(e: Column, product: str = "codeloom") -> Column:
    """The report record (AGT-14)."""
    return F.struct(
        executive_summary(e).alias("executive_summary"), security_section(e).alias("security_section"), modernization_section(e).alias("modernization_section"),
        quality_section(e).alias("quality_section"), F.transform(e["changes_summary"], lambda c: c["issue_type"]).alias("recommended_order"),
        F.concat(F.lit(f"[{product}] Modernize "), e["source"], F.lit(": "), _t(e["changes_proposed"]), F.lit(" changes")).alias("pr_description"),
        F.lit(f"git log --oneline | grep '\\[{product}\\]'  # find {product} commits\ngit revert <commit-hash>  # revert specific commit").alias("rollback_instructions"),
        markdown(e, product).alias("full_markdown"),
    )


def colour(risk: Column) -> Column:
    """Colour of a risk; unknown ones are grey, a missing one counts as MEDIUM."""
    out = F.lit("#6b7280")
    for name, value in COLOURS.items():
        out = F.when(F.coalesce(risk, F.lit("MEDIUM")) == name, value).otherwise(out)
    return out


def email(summary: Column, risk: Column, user: Column, source: Column, url: Column, product: str = "codeloom") -> Column:
    """A plain HTML message about a finished analysis."""
    return F.concat(
        F.lit(f"<!DOCTYPE html><html><body><h1>{product}</h1><p>Hi "), user, F.lit(",</p><p>Your analysis of <strong>"), source, F.lit('</strong> is complete.</p><div style="border-left:4px solid '),
        colour(risk), F.lit('">'), F.coalesce(summary, F.lit("Analysis complete.")), F.lit('</div><p><a href="'), F.coalesce(url, F.lit("#")), F.lit('">View Full Report</a></p></body></html>'),
    )


def write_reports(analyses: DataFrame, path: str) -> None:
    """Markdown reports as text, one row an analysis; records go out as JSON by :func:`to_json` (SNK-4)."""
    analyses.where("report_markdown is not null").select("id", "report_markdown").write.mode("overwrite").json(path)


def to_json(record: Column) -> Column:
    """A record as real JSON."""
    return F.to_json(record)
