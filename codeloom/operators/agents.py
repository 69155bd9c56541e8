"""The deterministic part of the model-driven stages, behind a pluggable interface (AGT-1 to AGT-11, JSN-1)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules, schemas
from ..functions.text import let, lines, strip
from .language import rule_key

Model = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _unfenced(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, r"```(?:json)?", ""))


def strict_json(text: Column) -> Column:
    """A text as a variant if the whole of it is one JSON value; Spark's own parser ignores what comes after the first.

    Put before a mark in a list, it must be the list's first element and the mark the second.
    """
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "␟"]')))
    return let(both, lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == "␟", F.try_variant_get(v, "$[0]", "variant")))


def json_list(raw: Column, keys: tuple[str, ...] = ("issues", "patterns", "results", "findings"), element: str = schemas.ISSUE) -> Column:
    """A list from a model's answer: the list itself, the first list under one of ``keys``, or the longest ``[...]`` (AGT-3, AGT-4)."""
    text = _unfenced(raw)
    kind = f"array<{element}>"

    def read(x: Column) -> Column:
        whole = strict_json(x)
        is_list = F.substring(x, 1, 1) == "["
        options = [F.when(is_list & whole.isNotNull(), F.try_variant_get(whole, "$", kind))]
        options += [F.when(~is_list, F.try_variant_get(whole, f"$.{k}", kind)) for k in keys]
        inner = F.regexp_extract(x, r"(?s)\[.*\]", 0)
        return F.coalesce(*options, F.try_variant_get(strict_json(F.nullif(inner, F.lit(""))), "$", kind))

    return read(text)


def json_object(raw: Column, needs: str) -> Column:
    """An object from a model's answer as a variant: whole if it has ``needs``, else the longest ``{...}`` (AGT-5, AGT-6)."""
    text = _unfenced(raw)
    whole = strict_json(text)
    inner = strict_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    has = (F.substring(text, 1, 1) == "{") & F.try_variant_get(whole, f"$.{needs}", "variant").isNotNull()
    return F.when(has, whole).otherwise(inner)


def read_answers(answers: DataFrame, raw: str, keys: tuple[str, ...] = ("issues", "patterns", "results", "findings"), element: str = schemas.ISSUE) -> DataFrame:
    """``answers`` with ``items``, the list of :func:`json_list`, and ``problem``, which tells apart what is none (JSN-1, AGT-3).

    A text is parsed once, to a variant, and once more only where the whole is no JSON.
    """
    text = _unfenced(F.col(raw))
    inner = F.nullif(F.regexp_extract("_text", r"(?s)\[.*\]", 0), F.lit(""))
    got = answers.withColumn("_text", text).withColumn("_whole", strict_json(F.col("_text")))
    kind = f"array<{element}>"
    lists = [F.try_variant_get("_whole", "$", kind), *[F.try_variant_get("_whole", f"$.{k}", kind) for k in keys]]
    got = got.withColumn("_inner", F.when(F.coalesce(*lists).isNull(), strict_json(inner)))
    got = got.withColumn("items", F.coalesce(*lists, F.try_variant_get("_inner", "$", kind)))
    problem = F.when(F.col("items").isNotNull(), None).when(F.col(raw).isNull(), "no answer").when(F.col("_whole").isNotNull() | F.col("_inner").isNotNull(), "no list").otherwise("no JSON")
    return got.withColumn("problem", problem).drop("_text", "_whole", "_inner")


def shift_lines(issue_lines: Column, offset: Column) -> Column:
    """Line numbers of a chunk as those of the file (AGT-2)."""
    return F.when(offset > 0, F.transform(issue_lines, lambda n: n + offset)).otherwise(issue_lines)


_RULES = "array<struct<legacy:string,modern:string,pattern:string>>"


def _rules() -> Column:
    """The golden rules by language as one literal, which is read once however many files there are."""
    table = {k: [dict(zip(("legacy", "modern", "pattern"), r, strict=True)) for r in rs] for k, rs in rules.GOLDEN.items()}
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{_RULES}>")


def rule_issues(files: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """``files`` with ``issues`` by rules, the default reader (AGT-1): a golden rule whose legacy text occurs, with its lines."""
    rows, own = lines(F.col(content)), F.try_element_at(_rules(), rule_key(F.col(language)))

    def one(r: Column) -> Column:
        at = F.filter(F.transform(rows, lambda x, i: F.when(F.contains(x, r["legacy"]), i + 1)), lambda n: n.isNotNull())
        issue = F.struct(
            r["pattern"].alias("issue_type"), F.concat(F.lit("Legacy "), F.replace(r["pattern"], F.lit("_"), F.lit(" "))).alias("description"), at.alias("affected_lines"), F.lit(2).alias("priority"),
            F.lit("low").alias("estimated_impact"), F.concat(F.lit("Use "), strip(r["modern"])).alias("modernization_hint"), F.lit(True).alias("safe_to_auto_fix"),
        )
        return F.when(F.contains(F.col(content), r["legacy"]) & (r["legacy"] != r["modern"]), issue)

    found = F.filter(F.transform(F.coalesce(own, F.array().cast(_RULES)), one), lambda x: x.isNotNull())
    return files.withColumn("issues", found.cast(f"array<{schemas.ISSUE}>"))


def rule_changes(files: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """``files`` with ``changes``: each issue's first line with the legacy text put right, the default modernizer.

    Issues that aren't safe become changes for people (AGT-7); those without lines get line 0.
    """
    rows, every = lines(F.col(content)), F.flatten(F.map_values(_rules()))
    kind = f"array<{schemas.EDIT}>"

    def fixed(issue: Column, i: Column) -> Column:
        first = F.coalesce(F.try_element_at(issue["affected_lines"], F.lit(1)), F.lit(0))
        last = F.coalesce(F.try_element_at(issue["affected_lines"], F.lit(-1)), F.lit(0))
        line = F.try_element_at(rows, F.when(first > 0, first))
        hits = lambda r: (issue["issue_type"] == r["pattern"]) & (r["legacy"] != r["modern"]) & F.contains(line, r["legacy"])
        new = F.aggregate(every, line, lambda was, r: F.when(hits(r), F.replace(line, r["legacy"], r["modern"])).otherwise(was))
        safe = F.coalesce(issue["safe_to_auto_fix"], F.lit(True))
        return F.struct(
            i.alias("ord"), issue["issue_type"].alias("issue_type"), F.when(safe, line).otherwise("").alias("old_code"), F.when(safe, new).otherwise("").alias("new_code"),
            first.alias("line_start"), F.when(safe, first).otherwise(last).alias("line_end"), issue["description"].alias("reason"),
            F.when(safe, "validated").otherwise("manual_required").alias("status"),
        )

    made = F.transform("issues", fixed)
    return files.withColumn("changes", F.filter(made, lambda c: (c["status"] == "manual_required") | (F.coalesce(c["old_code"], F.lit("")) != "")).cast(kind))


def with_model(files: DataFrame, model: Model, schema: str) -> DataFrame:
    """Files through a model of the caller's, batch by batch (AGT-1, AGT-15)."""
    return files.mapInPandas(model, schema)


def batches(issues: Column, size: int = 5) -> Column:
    """Issues in batches (AGT-7)."""
    n = F.ceil(F.size(issues) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(issues, i * size + 1, F.lit(size)))).otherwise(F.array().cast(f"array<array<{schemas.ISSUE}>>"))


def snippet(content: Column, affected: Column) -> Column:
    """Numbered lines around the affected ones: two before, three after (AGT-8)."""
    rows = lines(content)
    low, high = F.greatest(F.array_min(affected) - 3, F.lit(0)), F.array_max(affected) + 3
    numbered = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    return F.when(F.size(affected) > 0, F.array_join(F.slice(numbered, low + 1, F.greatest(F.least(high, F.size(rows)) - low, F.lit(0))), "\n"))


def checked_proposal(content: Column, change: Column) -> Column:
    """A proposed change with its status: null without old text, validated if the text has it verbatim (AGT-9); its line is the real one (AGT-10, AGT-11)."""
    old = F.coalesce(change["old_code"], F.lit(""))
    good = F.contains(content, old)
    out = change.withField("status", F.when(good, "validated").otherwise("validation_failed"))
    return F.when(old != "", out.withField("line_start", F.when(good, real_line(content, old)).otherwise(change["line_start"])))


def real_line(content: Column, old: Column) -> Column:
    """First line that has the first line of the old text, 0 if none has (AGT-11)."""
    head = F.element_at(F.split(strip(old), "\n"), 1)
    return let(head, lambda h: F.array_position(F.transform(lines(content), lambda x: F.contains(x, h)), True).cast("int"))


def function_summary(functions: Column) -> Column:
    """The first 20 functions in short; ``callers`` counts outgoing calls, as the field is defined (PRJ-7)."""
    return F.transform(
        F.slice(functions, 1, 20),
        lambda f: F.struct(
            f["name"].alias("name"), F.concat_ws("-", f["start_line"], f["end_line"]).alias("lines"), F.size(f["calls"]).alias("callers"), F.coalesce(f["is_public"], F.lit(True)).alias("is_public")
        ),
    )


__all__ = ["batches", "checked_proposal", "function_summary", "json_list", "json_object", "real_line", "rule_changes", "rule_issues", "shift_lines", "snippet", "with_model"]
