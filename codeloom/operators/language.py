"""Language and era of a source file (LNG-1 to LNG-6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import found


def literal_map(table: Mapping[str, object], kind: str = "string") -> Column:
    """A map literal; entries whose value is None are left out."""
    pairs = [F.lit(x) for k, v in table.items() if v is not None for x in (k, v)]
    return F.create_map(*pairs).cast(f"map<string,{kind}>")


def lookup(table: Mapping[str, object], key: Column, kind: str = "string") -> Column:
    """The key's value in a small literal table, null where it has none."""
    return F.try_element_at(literal_map(table, kind), F.coalesce(key, F.lit("")))


def extension(path: Column) -> Column:
    """Last suffix in lower case; names that only begin with a dot or end with one have none (LNG-1)."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def by_extension(path: Column) -> Column:
    """Language by extension, null if undecided (LNG-1)."""
    return lookup(rules.EXTENSIONS, extension(path))


def by_content(content: Column) -> Column:
    """Language by the first 2,000 characters, the first rule that holds (LNG-2)."""
    head = F.substring(content, 1, 2000)
    out = F.lit(None).cast("string")
    for language, regex, multiline in reversed(rules.CONTENT):
        value = F.when(F.contains(head, F.lit(".h")), "C").otherwise("C++") if language == "C" else F.lit(language)
        out = F.when(found(head, regex, multiline=multiline), value).otherwise(out)
    return out


def language(path: Column, content: Column) -> Column:
    """Language by extension, else by content, else Unknown."""
    return F.coalesce(by_extension(path), by_content(content), F.lit("Unknown"))


def era_hits(lang: Column, content: Column, signatures: Mapping[str, Sequence] | None = None) -> Column:
    """Signatures found in a file of this language, in order: array of (era, hint) (LNG-3)."""
    none = F.lit(None).cast("struct<era:string,hint:string>")

    def hits(rows: Sequence) -> Column:
        tests = [F.when(found(content, r, multiline=True), F.struct(F.lit(e).cast("string").alias("era"), F.lit(h).cast("string").alias("hint"))).otherwise(none) for r, e, h in rows]
        return F.filter(F.array(*tests), lambda x: x.isNotNull())

    out = F.array().cast("array<struct<era:string,hint:string>>")
    for name, rows in (signatures or rules.ERAS).items():
        out = F.when(lang == name, hits(rows)).otherwise(out)
    return out


def oldest(eras: Column) -> Column:
    """The era of least rank, the first of equal ones, null if there is none (SRT-4)."""
    rank = lambda e: F.coalesce(lookup(rules.ERA_RANK, e, "int"), F.lit(99))
    return F.aggregate(eras, F.lit(None).cast("string"), lambda a, e: F.when(a.isNull() | (rank(e) < rank(a)), e).otherwise(a))


def detect(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``files`` with ``language``, ``era``, ``version_hint``, ``extension``, ``confidence`` (LNG-4)."""
    named = files.withColumns({"language": language(F.col(path), F.col(content)), "extension": extension(F.col(path))})
    hit = named.withColumn("_hits", era_hits(F.col("language"), F.col(content)))
    hints = F.filter(F.transform("_hits", lambda x: x["hint"]), lambda x: x.isNotNull())
    eras = F.filter(F.transform("_hits", lambda x: x["era"]), lambda x: x.isNotNull())
    unknown = F.col("language") == "Unknown"
    return hit.withColumns(
        {
            "era": F.when(unknown, "unknown").otherwise(F.coalesce(oldest(eras), F.concat("language", F.lit(" (modern)")))),
            "version_hint": F.when(unknown, "").when(F.size(hints) > 0, F.array_join(hints, "; ")).otherwise(F.concat("language", F.lit(" (no era markers detected)"))),
            "confidence": F.when(unknown, "low").when(F.size(hints) > 0, "high").otherwise("medium"),
        }
    ).drop("_hits")


def rule_key(lang: Column) -> Column:
    """Key of a language's modernisation rules (LNG-5)."""
    return F.coalesce(lookup(rules.RULE_KEYS, lang), F.lower(lang))


def parser_key(lang: Column) -> Column:
    """Key of a language's parser. C++ and C# get theirs, which lower-casing alone would miss (LNG-6, on purpose)."""
    return F.when(lang == "C++", "cpp").when(lang == "C#", "c_sharp").otherwise(F.lower(lang))


def breakdown(files: DataFrame, keys: Sequence[str] = ("analysis_id",)) -> DataFrame:
    """Files a language and their rounded percentage, half to even (AGG-1)."""
    counted = files.withColumn("language", F.coalesce("language", F.lit("Unknown"))).groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("files"))
    total = counted.groupBy(*keys).agg(F.sum("files").alias("total"))
    percent = F.bround(F.col("files") / F.col("total") * 100).cast("int")
    return counted.join(total, list(keys)).select(*keys, "language", "files", percent.alias("percent"))


def breakdown_map(files: DataFrame, keys: Sequence[str] = ("analysis_id",)) -> DataFrame:
    """:func:`breakdown` as one map a key."""
    return breakdown(files, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "percent")))).alias("language_breakdown"))
