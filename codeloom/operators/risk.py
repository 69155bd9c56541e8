"""Risk of proposed changes (JOIN-3, JOIN-4, AGG-14 to AGG-16, AGT-12, AGT-13, PRJ-5, PRJ-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .graph import calling_functions
from .language import lookup
from .scan import io_imports


def with_risk(changes: DataFrame, risks: DataFrame, keys: tuple[str, ...] = ("file_id",), first: bool = False) -> DataFrame:
    """Changes with the risk of their issue type: the last assessment (as stored, JOIN-3) or the first (as reported, JOIN-4).

    ``risks(*keys, ord, issue_type, risk, reason, confidence, callers_affected)``. One row a key and type is
    kept before the join, so it can't multiply changes.
    """
    pick = F.min_by if first else F.max_by
    one = risks.groupBy(*keys, "issue_type").agg(pick(F.struct("risk", "reason", "confidence", "callers_affected"), "ord").alias("_r"))
    out = changes.join(one, [*keys, "issue_type"], "left")
    return out.withColumns(
        {
            "risk_level": F.coalesce("_r.risk", F.lit("MEDIUM")),
            "risk_reason": F.coalesce("_r.reason", F.lit("")),
            "confidence": F.col("_r.confidence"),
            "callers": F.coalesce("_r.callers_affected", F.lit(0)),
        }
    ).drop("_r")


def hours_saved(changes: Column) -> Column:
    """Hours that the validated changes of an array save, one digit (AGG-14)."""
    hours = lambda c: F.coalesce(lookup(rules.HOURS, c["issue_type"], "double"), F.lit(rules.HOURS_OTHERWISE))
    valid = F.filter(changes, lambda c: F.coalesce(c["status"] == "validated", F.lit(False)))
    return F.round(F.aggregate(valid, F.lit(0.0), lambda a, c: a + hours(c)), 1)


def hours_by(changes: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """:func:`hours_saved` over rows, grouped. Hours are summed as hundredths, so the order of rows can't matter."""
    cents = F.round(F.coalesce(lookup(rules.HOURS, F.col("issue_type"), "double"), F.lit(rules.HOURS_OTHERWISE)) * 100).cast("long")
    total = F.sum(F.when(F.col("status") == "validated", cents).otherwise(0))
    return changes.groupBy(*keys).agg(F.round(total / 100.0, 1).alias("estimated_hours_saved"))


def overall_score(low: Column, medium: Column, high: Column) -> Column:
    """0 to 100, truncated; 100 if there is nothing to score (AGG-15)."""
    share = F.try_divide(low * 1.0 + medium * 0.5, low + medium + high) * 100
    return F.when(low + medium + high == 0, 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), share.cast("int"))))


def rule_risk(issue_type: Column, tests_pass: Column) -> Column:
    """Risk of a change by its type and the tests (AGG-16)."""
    kind = F.coalesce(issue_type, F.lit(""))
    return F.when(kind.isin(*rules.SAFE_TYPES) & tests_pass, "LOW").when(kind.isin(*rules.RISKY_TYPES) | ~tests_pass, "HIGH").otherwise("MEDIUM")


def assess(changes: Column, regression: Column) -> Column:
    """The risk record of a file's changes by rules (AGG-16, AGT-13); no changes are LOW with a score of 100."""
    ok = ~F.coalesce(regression, F.lit(False))

    def one(c: Column) -> Column:
        risk = rule_risk(c["issue_type"], ok)
        safe = risk == "LOW"
        return F.struct(
            F.coalesce(c["issue_type"], F.lit("")).alias("issue_type"), risk.alias("risk"), F.lit(0.7).alias("confidence"),
            F.concat(F.lit("Rule-based assessment: "), F.when(safe, "safe pattern").otherwise("requires review")).alias("reason"),
            F.lit(0).alias("callers_affected"), (~safe).alias("behavioral_change_possible"),
            F.when(safe, "Apply").otherwise("Review manually").alias("recommended_action"),
        )

    each = F.transform(changes, one)
    count = lambda level: F.size(F.filter(each, lambda r: r["risk"] == level))
    low, medium, high = count("LOW"), count("MEDIUM"), count("HIGH")
    return F.struct(
        F.when(high > 0, "HIGH").when(medium > 0, "MEDIUM").otherwise("LOW").alias("overall_risk"),
        F.greatest(F.lit(0), 100 - high * 30 - medium * 10).alias("overall_score"),
        F.concat(low.cast("string"), F.lit(" changes safe to apply immediately")).alias("modernization_readiness"),
        hours_saved(changes).alias("estimated_hours_saved"), each.alias("per_change_risk"),
        F.struct(low.alias("low_count"), medium.alias("medium_count"), high.alias("high_count"), low.alias("auto_applicable")).alias("risk_summary"),
    )


def fallback_by(changes: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Counts, overall risk and score over rows ``(*keys, issue_type, regression)``, grouped (AGG-16)."""
    risk = rule_risk(F.col("issue_type"), ~F.coalesce(F.col("regression"), F.lit(False)))
    by = changes.withColumn("_risk", risk).groupBy(*keys).agg(*[F.count_if(F.col("_risk") == x).alias(x.lower()) for x in ("LOW", "MEDIUM", "HIGH")])
    return by.withColumns(
        {
            "overall_risk": F.when(F.col("high") > 0, "HIGH").when(F.col("medium") > 0, "MEDIUM").otherwise("LOW"),
            "overall_score": F.greatest(F.lit(0), 100 - F.col("high") * 30 - F.col("medium") * 10).cast("int"),
        }
    )


def previews(changes: Column) -> Column:
    """Changes with 80-character previews, for the evidence (PRJ-5)."""
    text = lambda c, f: F.coalesce(c[f], F.lit(""))
    return F.transform(
        changes,
        lambda c: F.struct(
            c["issue_type"].alias("issue_type"), F.substring(text(c, "old_code"), 1, 80).alias("old_code_preview"), F.substring(text(c, "new_code"), 1, 80).alias("new_code_preview"),
            text(c, "reason").alias("reason"), F.coalesce(c["status"], F.lit("validated")).alias("status"),
        ),
    )


def change_summary(changes: Column, risks: Column) -> Column:
    """Validated changes with 60-character previews and the first risk of their type (PRJ-6)."""
    valid = F.filter(changes, lambda c: F.coalesce(c["status"] == "validated", F.lit(False)))

    def one(c: Column) -> Column:
        own = F.filter(risks, lambda r: r["issue_type"] == c["issue_type"])
        return F.struct(
            c["issue_type"].alias("issue_type"), F.substring(F.coalesce(c["old_code"], F.lit("")), 1, 60).alias("old_preview"),
            F.substring(F.coalesce(c["new_code"], F.lit("")), 1, 60).alias("new_preview"),
            F.coalesce(F.try_element_at(F.transform(own, lambda r: r["risk"]), F.lit(1)), F.lit("MEDIUM")).alias("risk"), F.coalesce(c["reason"], F.lit("")).alias("reason"),
        )

    return F.transform(valid, one)


def evidence(graph: Column, modules: Column, changes: Column, tests: Column, diff: Column, security: Column) -> Column:
    """What the risk assessment is based on (AGT-12)."""
    return F.struct(
        previews(changes).alias("changes"), tests.alias("tests"), diff.alias("diff"), calling_functions(graph).alias("functions_with_calls"),
        io_imports(modules).alias("io_imports"), security.alias("security"),
    )
