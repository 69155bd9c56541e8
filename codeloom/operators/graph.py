"""Call graphs within files and across them (AGG-12, AGG-13, AGG-19, AGG-20, JOIN-11, DEP-1, FLT-7, FLT-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calls(functions: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row a listed call: ``(*keys, caller, callee)`` from ``(*keys, name, calls)``."""
    return functions.select(*keys, F.col("name").alias("caller"), F.explode("calls").alias("callee"))


def caller_counts(functions: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """How many functions call each name, one for each entry in their lists (AGG-12)."""
    return calls(functions, keys).groupBy(*keys, "callee").agg(F.count(F.lit(1)).alias("callers"))


def calling_functions(graph: Column) -> Column:
    """Number of functions with at least one call (AGG-13)."""
    return F.size(F.map_filter(graph, lambda _, v: F.size(v) > 0))


def with_calls(graph: Column) -> Column:
    """The entries that list calls (FLT-7)."""
    return F.map_filter(graph, lambda _, v: F.size(v) > 0)


def busy(graph: Column, least: int = 2) -> Column:
    """Names with more than so many calls (FLT-8)."""
    return F.array_sort(F.map_keys(F.map_filter(graph, lambda _, v: F.size(v) > least)))


def exported_symbols(symbols: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The path that exports each public name: functions before classes, files in order, the last wins (AGG-19).

    ``symbols(*keys, file_idx, path, kind, ord, name, is_public)`` with kind 0 for functions, 1 for classes.
    """
    last = F.max_by("path", F.struct("file_idx", "kind", "ord"))
    return symbols.where("is_public").groupBy(*keys, "name").agg(last.alias("path"))


def call_sites(imports: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sorted distinct files that import each name (AGG-20), from ``(*keys, path, name)``."""
    return imports.groupBy(*keys, "name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def cross_file_edges(functions: DataFrame, exported: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Calls whose first dotted part another file exports: ``(*keys, caller_id, callee_id)`` (JOIN-11)."""
    made = calls(functions, (*keys, "path")).withColumn("symbol", F.substring_index("callee", ".", 1))
    to = exported.select(*keys, F.col("name").alias("symbol"), F.col("path").alias("to_path"))
    found = made.join(to, [*keys, "symbol"]).where(F.col("path") != F.col("to_path"))
    return found.select(*keys, F.concat_ws("@", "caller", "path").alias("caller_id"), F.concat_ws("@", "callee", "to_path").alias("callee_id")).distinct()


def repository(parsed: DataFrame) -> dict[str, DataFrame]:
    """Exported symbols, call sites and cross-file edges of parsed files, by analysis (DEP-1).

    ``parsed(analysis_id, file_idx, path, ast)``; the tables go by names, so their hubs are only aggregated.
    """
    a, who = ["analysis_id"], ["analysis_id", "file_idx", "path"]
    functions = parsed.select(*who, F.posexplode("ast.functions").alias("ord", "x")).select(*who, F.lit(0).alias("kind"), "ord", "x.name", "x.is_public", "x.calls")
    classes = parsed.select(*who, F.posexplode("ast.classes").alias("ord", "x")).select(*who, F.lit(1).alias("kind"), "ord", "x.name", "x.is_public")
    exported = exported_symbols(functions.drop("calls").unionByName(classes), tuple(a))
    names = parsed.select(*who, F.explode("ast.imports").alias("x")).select(*who, F.explode("x.names").alias("name"))
    return {"exported_symbols": exported, "call_sites": call_sites(names, tuple(a)), "cross_file_graph": cross_file_edges(functions, exported, tuple(a))}


__all__ = ["busy", "call_sites", "caller_counts", "calling_functions", "calls", "cross_file_edges", "exported_symbols", "repository", "with_calls"]
