"""Text edits, diffs and their validation (EDIT-1 to EDIT-7, SRT-2, SRT-6, SET-2, SET-3)."""

from __future__ import annotations

import difflib
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, occurrences, pieces, quoted, strip
from ..session import small_batches


def in_order(changes: Column) -> Column:
    """Edits from the last line to the first, input order among those of one line (SRT-2)."""

    def compare(a: Column, b: Column) -> Column:
        x, y = F.coalesce(a["line_start"], F.lit(0)), F.coalesce(b["line_start"], F.lit(0))
        return F.when(x > y, -1).when(x < y, 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)

    return F.array_sort(changes, compare)


def chosen_place(text: Column, part: Column, line_start: Column) -> Column:
    """Place of the occurrence that a line number means, null if the number is none of the text's (EDIT-2, SRT-6).

    The first at or after the line's start, else the nearest. That is the last one then, as all lie before: looked for from the
    end, so the work is linear in the text.
    """
    rows = pieces(text)
    before = F.slice(rows, F.lit(1), F.greatest(line_start - 1, F.lit(0)))
    start = F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x))

    def choose(offset: Column) -> Column:
        after = F.call_function("locate", part, text, offset + 1)
        from_end = F.call_function("locate", F.reverse(part), F.reverse(text))
        return F.when(after > 0, after - 1).when(from_end > 0, F.length(text) - from_end + 1 - F.length(part))

    good = line_start.isNotNull() & (line_start > 0) & (line_start <= F.size(rows))
    return F.when(good, let(start, choose))


def apply_edits(content: Column, changes: Column) -> Column:
    """Struct of ``text``, the ``applied`` edits' and ``rejected`` edits' ordinals with reasons (EDIT-1).

    A fold over the ordered edits, each of which sees the text that the ones before left. An edit needs an
    occurrence; of several one must be meant by its line number.
    """
    rejected_kind = "array<struct<ord:int,issue_type:string,reason:string>>"
    first = F.struct(content.alias("text"), F.array().cast("array<int>").alias("applied"), F.array().cast(rejected_kind).alias("rejected"))

    def step(acc: Column, c: Column) -> Column:
        old, new, text = F.coalesce(c["old_code"], F.lit("")), F.coalesce(c["new_code"], F.lit("")), acc["text"]
        count = occurrences(text, old)
        place = F.when(count == 1, F.call_function("locate", old, text) - 1).when(count > 1, chosen_place(text, old, c["line_start"]))
        shown = quoted(F.substring(old, 1, 60))
        reason = (
            F.when(old == "", "old_code is empty")
            .when(count == 0, F.concat(F.lit("old_code not found verbatim in file: "), shown))
            .otherwise(F.concat(F.lit("old_code matches "), count, F.lit(" locations in file (ambiguous, could not disambiguate by line number): "), shown))
        )

        def done(p: Column) -> Column:
            swapped = F.concat(F.substring(text, F.lit(1), p), new, F.substring(text, p + F.length(old) + 1, F.length(text)))
            good = F.struct(swapped.alias("text"), F.array_append(acc["applied"], c["ord"]).alias("applied"), acc["rejected"].alias("rejected"))
            note = F.struct(c["ord"].alias("ord"), c["issue_type"].alias("issue_type"), reason.alias("reason"))
            bad = F.struct(text.alias("text"), acc["applied"].alias("applied"), F.array_append(acc["rejected"], note).alias("rejected"))
            return F.when(p.isNotNull(), good).otherwise(bad)

        return let(place, done)

    return F.aggregate(in_order(changes), first, step)


_DIFF = "unified_diff string, minimality_score double, lines_changed int, total_lines int"


def _diff(original: str | None, modified: str | None) -> tuple[str, float, int, int]:
    before, after = (original or "").splitlines(keepends=True), (modified or "").splitlines(keepends=True)
    delta = list(difflib.unified_diff(before, after, "original", "modernized", lineterm=""))
    # Lines that themselves begin with -- or ++ look like file headers and aren't counted; the score is defined so.
    marked = [x for x in delta if x[:1] in "+-" and x[:3] not in ("+++", "---")]
    total = len(before)
    score = round((total - len(marked) / 2) / total * 100, 2) if total else 100.0
    return "".join(delta), min(100.0, max(0.0, score)), len(marked) // 2, total


def diff(original: Column, modified: Column) -> Column:
    """Unified diff and how little was changed (EDIT-3, EDIT-4); the matcher's heuristics have no native form."""
    return F.pandas_udf(_diff_batch, _DIFF)(original, modified)


def _diff_batch(original: pd.Series, modified: pd.Series) -> pd.DataFrame:
    rows = [_diff(a, b) for a, b in zip(original, modified, strict=True)]
    return pd.DataFrame(rows, columns=["unified_diff", "minimality_score", "lines_changed", "total_lines"])


def modernise(files: DataFrame, content: str = "content", changes: str = "changes") -> DataFrame:
    """``files`` with ``diff_result``: modified file, diff, counts and reasons."""
    small_batches(files.sparkSession)
    edited = files.withColumn("_e", apply_edits(F.col(content), F.coalesce(F.col(changes), F.array().cast(dict(files.dtypes)[changes]))))
    edited = edited.withColumn("_d", diff(F.col(content), F.col("_e.text")))
    result = F.struct(
        F.col(content).alias("original_file"), F.col("_e.text").alias("modified_file"), F.col("_d.unified_diff"), F.size("_e.applied").alias("changes_applied"),
        F.size("_e.rejected").alias("changes_rejected"), F.col("_e.rejected").alias("rejection_reasons"), F.col("_d.minimality_score"),
        F.col("_d.lines_changed"), F.col("_d.total_lines"),
    )
    return edited.withColumn("diff_result", result).drop("_e", "_d")


def validate(before: Column, after: Column) -> Column:
    """Compare two parse records: syntax, missing functions, new imports (EDIT-5, JOIN-12, SET-2)."""
    names = lambda p: F.transform(p["functions"], lambda f: f["name"])
    modules = lambda p: F.transform(p["imports"], lambda i: i["module"])
    missing = F.array_sort(F.array_except(names(before), names(after)))
    added = F.array_sort(F.array_except(modules(after), modules(before)))
    valid = ~F.coalesce(after["has_parse_errors"], F.lit(False))
    issues = F.filter(
        F.array(
            F.when(~valid, "Modified file has syntax errors (AST parse failed)"),
            F.when(F.size(missing) > 0, F.concat(F.lit("Functions removed from modified file: "), F.array_join(missing, ", "))),
            F.when(F.size(added) > 0, F.concat(F.lit("New imports detected: "), F.array_join(added, ", "))),
        ),
        lambda x: x.isNotNull(),
    )
    kept = F.size(missing) == 0
    return F.struct(valid.alias("ast_valid"), kept.alias("signatures_preserved"), added.alias("unexpected_imports"), (valid & kept).alias("validation_passed"), issues.alias("issues"))


def validate_strict(before: Column, after: Column) -> Column:
    """As :func:`validate`, by syntax errors that were not there before, with the change of complexity (EDIT-6, SET-3)."""
    names = lambda p: F.transform(p["functions"], lambda f: f["name"])
    total = lambda p: F.aggregate(p["functions"], F.lit(0), lambda a, f: a + F.coalesce(f["complexity"], F.lit(0)))
    raw = lambda p: F.transform(p["imports"], lambda i: i["raw"])
    worse = after["error_node_count"] > before["error_node_count"]
    missing = F.array_sort(F.array_except(names(before), names(after)))
    return F.struct(
        (~worse & (F.size(missing) == 0)).alias("valid"), missing.alias("missing_functions"), F.array_sort(F.array_except(raw(after), raw(before))).alias("new_imports"),
        (after["error_node_count"] - before["error_node_count"]).alias("new_errors"), (total(after) - total(before)).alias("complexity_delta"),
    )


def same_code(a: Column, b: Column) -> Column:
    """Equal but for spaces; an empty side equals nothing (EDIT-7)."""
    plain = lambda x: F.replace(strip(x), F.lit(" "), F.lit(""))
    return F.coalesce((a != "") & (b != "") & (plain(a) == plain(b)), F.lit(False))


def commit(files: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("analysis_id", "file_path")) -> DataFrame:
    """Files that the accepted changes alter, with a message of their issue types (SNK-6, AGG-21, SNK-5).

    ``files(*keys, content)``, ``changes(*keys, ord, ..., status)``.
    """
    fields = ("ord", "issue_type", "old_code", "new_code", "line_start", "line_end", "reason", "status")
    accepted = changes.where(F.col("status") == "accepted").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("changes"))
    edited = files.join(accepted, list(keys)).withColumn("modified", apply_edits(F.col("content"), F.col("changes"))["text"])
    types = F.array_sort(F.array_distinct(F.transform("changes", lambda c: c["issue_type"])))
    return edited.where(F.col("modified") != F.col("content")).select(*keys, "modified", F.concat(F.lit("Modernize: "), F.array_join(types, ", ")).alias("message"))
