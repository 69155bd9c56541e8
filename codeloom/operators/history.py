"""Queries over stored analyses, changes and accounts (FLT-*, SRT-1, PRJ-1 to PRJ-4, JOIN-1, JOIN-2, JOIN-14, UPD-4, UPD-6 to UPD-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the end of addresses that stand in for missing ones.
PLACEHOLDER = "@github.noemail"


def contains_text(text: Column, part: str) -> Column:
    """Case-insensitive substring; null text has none."""
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def history(analyses: DataFrame, user_id: object, language: str | None = None, risk: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a user's analyses, the newest first, ties by id (FLT-1, SRT-1); filters are pushed to the scan."""
    out = analyses.where(F.col("user_id") == user_id)
    if language:
        out = out.where(F.col("language") == language)
    if risk:
        out = out.where(F.col("overall_risk") == risk.upper())
    return out.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def page_total(page: DataFrame) -> DataFrame:
    """The page's length, which is reported as the total (AGG-24)."""
    return page.agg(F.count(F.lit(1)).alias("total"))


def screen(analyses: DataFrame, language: str = "", risk: str = "", status: str = "", search: str = "") -> DataFrame:
    """The list's own filters; an empty one passes all (FLT-2)."""
    for column, value in (("language", language), ("overall_risk", risk), ("status", status)):
        if value:
            analyses = analyses.where(F.col(column) == value)
    return analyses.where(contains_text(F.col("source_name"), search)) if search else analyses


def history_screen(analyses: DataFrame, user_id: object, search: str = "", **filters: str) -> DataFrame:
    """What the list shows: its filters go over the newest 50 only."""
    return screen(history(analyses, user_id, limit=50), search=search, **filters)


def languages(analyses: DataFrame) -> DataFrame:
    """Distinct non-empty languages, by first appearance in (created_at desc, id) (SET-1)."""
    first = F.min(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "id"))
    return analyses.where("language is not null and language <> ''").groupBy("language").agg(first.alias("_f")).orderBy("_f").select("language")


def repositories(repos: DataFrame, search: str = "", limit: int = 30) -> DataFrame:
    """Repositories whose name has a text (FLT-3)."""
    return (repos.where(contains_text(F.col("name"), search)) if search else repos).limit(limit)


def recent_repositories(repos: DataFrame, limit: int = 50) -> DataFrame:
    """The last updated ones, nine fields (SRC-4)."""
    fields = ("id", "name", "full_name", "private", "language", "description", "default_branch", "updated_at", "html_url")
    return repos.orderBy(F.col("updated_at").desc(), "id").limit(limit).select(*fields)


def low_pending(changes: DataFrame) -> DataFrame:
    """Changes that accept-all-LOW takes (FLT-6). Stored changes are never pending, so fresh rows have none."""
    return changes.where((F.col("risk_level") == "LOW") & (F.col("status") == "pending"))


def with_status(changes: DataFrame, *statuses: str) -> DataFrame:
    """Changes of these statuses (FLT-4)."""
    return changes.where(F.col("status").isin(*statuses))


def split_issues(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues to fix and issues for people; safe unless said otherwise (FLT-5)."""
    safe = F.coalesce("safe_to_auto_fix", F.lit(True))
    return issues.where(safe), issues.where(~safe)


def real_address(email: Column) -> Column:
    """Whether an address is one to write to (FLT-12)."""
    return F.coalesce((email != "") & ~F.contains(email, F.lit(PLACEHOLDER)), F.lit(False))


def iso(ts: Column) -> Column:
    """A time as ISO text, with microseconds only if there are any (PRJ-1, DTE-1)."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def user_view(users: DataFrame) -> DataFrame:
    """Ten fields of a user (PRJ-1)."""
    return users.select("id", "email", "name", "photo_url", "phone", "auth_provider", "email_reports", "risk_threshold", "theme", iso(F.col("created_at")).alias("created_at"))


def connection_view(connections: DataFrame) -> DataFrame:
    """Five fields of a connection, without its token (PRJ-2)."""
    return connections.select("id", "github_username", "avatar_url", "is_primary", iso(F.col("connected_at")).alias("connected_at"))


def analysis_view(analyses: DataFrame) -> DataFrame:
    """The list's fields of an analysis (PRJ-3); the report columns aren't read."""
    plain = (
        "id", "input_mode", "source_name", "github_repo", "status", "error_message", "language", "era", "language_breakdown", "total_files",
        "total_issues", "security_issues", "overall_risk", "minimality_score", "complexity_before", "complexity_after", "confidence_score",
        "estimated_hours_saved", "tests_passed", "test_count",
    )
    return analyses.select(*plain, iso(F.col("created_at")).alias("created_at"), iso(F.col("completed_at")).alias("completed_at"), "full_report", "report_markdown")


def change_view(changes: DataFrame) -> DataFrame:
    """Fourteen fields of a change (PRJ-4)."""
    return changes.select("id", "file_path", "issue_type", "description", "old_code", "new_code", "line_start", "line_end", "risk_level", "risk_reason", "confidence", "priority", "callers", "status")


def with_changes(analyses: DataFrame, changes: DataFrame) -> DataFrame:
    """Analyses with their changes as an array (JOIN-1)."""
    fields = [c for c in changes.columns if c != "analysis_id"]
    own = changes.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("changes")).withColumnRenamed("analysis_id", "id")
    return analyses.join(own, "id", "left")


def with_connections(users: DataFrame, connections: DataFrame) -> DataFrame:
    """Users with their connections, one row each pair (JOIN-2)."""
    own = connection_view(connections.withColumnRenamed("id", "cid").withColumn("id", F.col("cid"))).withColumnRenamed("id", "connection_id")
    keyed = connections.select(F.col("id").alias("connection_id"), F.col("user_id").alias("id"))
    return users.join(keyed.join(own, "connection_id"), "id", "left")


def set_status(changes: DataFrame, ids: Sequence[object], status: str, analyses: DataFrame | None = None, user_id: object | None = None) -> DataFrame:
    """Changes with a new status for the given ids (UPD-7, JOIN-14); with ``user_id`` only those of the user's analyses."""
    chosen = F.col("id").isin(*ids) if ids else F.lit(False)
    if user_id is not None:
        own = analyses.where(F.col("user_id") == user_id).select(F.col("id").alias("analysis_id"), F.lit(True).alias("_own"))
        changes, chosen = changes.join(own, "analysis_id", "left"), chosen & F.coalesce("_own", F.lit(False))
    return changes.withColumn("status", F.when(chosen, status).otherwise(F.col("status"))).drop("_own")


def patch(rows: DataFrame, news: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the non-null fields of an update (UPD-6)."""
    fields = [c for c in news.columns if c != key]
    joined = rows.join(news.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def chosen_connection(connections: DataFrame, user_id: object, connection_id: object | None = None) -> DataFrame:
    """The connection of an id, else the user's primary one (UPD-4)."""
    own = connections.where(F.col("user_id") == user_id)
    return own.where(F.col("id") == connection_id) if connection_id else own.where("is_primary").orderBy("connected_at", "id").limit(1)


def without_connection(connections: DataFrame, user_id: object, connection_id: object) -> DataFrame:
    """Connections without the user's one of this id (UPD-9)."""
    return connections.where(~((F.col("id") == connection_id) & (F.col("user_id") == user_id)))


def latest_status(events: DataFrame, key: str = "analysis_id") -> DataFrame:
    """The last status of each analysis by time (UPD-8), from ``(key, status, ts, seq)``."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def email_decision(email_reports: Column, has_report: Column, email: Column, has_key: Column, override: str | None = None) -> Column:
    """Whether a report goes out and to whom: struct of decision and recipient (UPD-10, SNK-7)."""
    decision = (
        F.when(~F.coalesce(email_reports, F.lit(False)), "skipped_user_disabled").when(~F.coalesce(has_report, F.lit(False)), "skipped_no_report")
        .when(~real_address(email), "skipped_placeholder").when(~F.coalesce(has_key, F.lit(False)), "skipped_no_key").otherwise("send")
    )
    return F.struct(decision.alias("decision"), F.when(decision == "send", F.coalesce(F.lit(override), email)).alias("recipient"))
