"""Two versions of files compared as relations of their lines, without a parser (JOIN-12, SET-2, SET-3, EDIT-5).

Headers and imports are found by line patterns, so a file of any length is spread by its lines; versions meet in a full outer join on
file and name. A name that a file defines several times counts by its first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

HEADER = r"^\s*(?:async\s+)?(?:def|function|func|fn)\s+(\w+)\s*\(([^)]*)\)"
IMPORT = r"^\s*(?:import|from|use|require)\s+([\w.]+)"


def _arity(params: Column) -> Column:
    return F.size(F.filter(F.split(params, ","), lambda p: ~strip(p).isin("", "self", "&self", "&mut self")))


def headers(code_lines: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """``(*keys, name, arity)`` of the functions that lines begin; the first of a name."""
    found = code_lines.where(F.regexp_like("line", F.lit(HEADER)))
    found = found.select(*keys, "line_no", F.regexp_extract("line", HEADER, 1).alias("name"), _arity(F.regexp_extract("line", HEADER, 2)).alias("arity"))
    return found.groupBy(*keys, "name").agg(F.min_by("arity", "line_no").alias("arity"))


def imports(code_lines: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Distinct ``(*keys, module)`` of the lines that import."""
    module = F.regexp_extract("line", IMPORT, 1)
    return code_lines.select(*keys, module.alias("module")).where("module <> ''").distinct()


def changed_functions(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """``(*keys, name, change, arity_before, arity_after)``; ``change`` is missing, new, arity or same (JOIN-12)."""
    a = headers(before, keys).withColumnRenamed("arity", "arity_before")
    both = a.join(headers(after, keys).withColumnRenamed("arity", "arity_after"), [*keys, "name"], "full")
    change = F.when(F.col("arity_after").isNull(), "missing").when(F.col("arity_before").isNull(), "new").when(F.col("arity_before") != F.col("arity_after"), "arity").otherwise("same")
    return both.select(*keys, "name", change.alias("change"), "arity_before", "arity_after")


def new_imports(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """``(*keys, module)`` that only the later version imports (SET-3)."""
    return imports(after, keys).join(imports(before, keys), [*keys, "module"], "left_anti")


def verdicts(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """One row a file of the earlier version: what is missing or new, and whether that passes (EDIT-5, SET-2)."""
    names = changed_functions(before, after, keys).where("change IN ('missing', 'arity')").groupBy(*keys)
    names = names.agg(F.array_sort(F.collect_list(F.when(F.col("change") == "missing", F.col("name")))).alias("missing"), F.count_if(F.col("change") == "arity").alias("arity_changes"))
    added = new_imports(before, after, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("module")).alias("unexpected_imports"))
    got = before.select(*keys).distinct().join(names, list(keys), "left").join(added, list(keys), "left")
    none = F.array().cast("array<string>")
    got = got.withColumns({"missing": F.coalesce("missing", none), "unexpected_imports": F.coalesce("unexpected_imports", none), "arity_changes": F.coalesce("arity_changes", F.lit(0))})
    told = [
        F.when(F.size("missing") > 0, F.concat(F.lit("Functions removed from modified file: "), F.array_join("missing", ", "))),
        F.when(F.size("unexpected_imports") > 0, F.concat(F.lit("New imports detected: "), F.array_join("unexpected_imports", ", "))),
    ]
    return got.withColumns({"signatures_preserved": F.size("missing") == 0, "issues": F.filter(F.array(*told), lambda x: x.isNotNull())})
