"""Line rules for security findings and secrets, imports and input/output (CHK-0, SCN-*, IO-1, IMP-2, IMP-3, AGG-8)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import found, lines


def explode_lines(files: DataFrame, content: str = "content", split: Callable[[Column], Column] = lines) -> DataFrame:
    """One row a line, numbered from 1 (CHK-0). ``split`` says what a line is."""
    kept = [c for c in files.columns if c != content]
    return files.select(*kept, F.posexplode(split(F.col(content))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def hits(line: Column, table: Sequence[tuple[str, str, str]]) -> Column:
    """Rules that hold for a line, in order: array of (rule_ord, severity, issue) (JOIN-6).

    The rules are one literal array, so the plan has no join and the order is free.
    """
    none = F.lit(None).cast("struct<rule_ord:int,severity:string,issue:string>")
    tests = [
        F.when(found(line, regex, ignore_case=True), F.struct(F.lit(k).alias("rule_ord"), F.lit(severity).alias("severity"), F.lit(issue).alias("issue"))).otherwise(none)
        for k, (regex, severity, issue) in enumerate(table)
    ]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def secret_hits(line: Column) -> Column:
    """Numbers of the secret rules that hold for a line (SCN-3)."""
    tests = [F.when(found(line, regex, ignore_case=i), F.lit(k)) for k, (regex, i) in enumerate(rules.SECRETS)]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def findings(code_lines: DataFrame, python: Column | None = None, line: str = "line") -> DataFrame:
    """One row a line and rule: ``rule_ord``, ``severity``, ``issue`` and ``tool`` (SCN-1, SCN-2, SCN-4).

    ``python`` marks lines that get the Python rules; by default none does.
    """
    kept = [c for c in code_lines.columns if c != line]
    found_in = hits(F.col(line), rules.GENERIC_SCAN)
    tool = F.lit("heuristic")
    if python is not None:
        found_in = F.when(python, hits(F.col(line), rules.PYTHON_SCAN)).otherwise(found_in)
        tool = F.when(python, "heuristic_python").otherwise(tool)
    out = code_lines.select(*kept, tool.alias("tool"), F.inline(found_in))
    return out.withColumns({"confidence": F.lit("MEDIUM"), "test_id": F.lit("heuristic"), "cwe": F.lit("")})


def secrets(code_lines: DataFrame, line: str = "line") -> DataFrame:
    """One row a line and secret rule (SCN-3, SCN-6)."""
    kept = [c for c in code_lines.columns if c != line]
    out = code_lines.select(*kept, F.explode(secret_hits(F.col(line))).alias("rule_ord"))
    return out.withColumns({"type": F.lit("possible_secret"), "verified": F.lit(False)})


def summary(code_lines: DataFrame, key: str = "file_id", python: Column | None = None, line: str = "line") -> DataFrame:
    """Findings by severity, secrets and the gate of every file, also of files without any (AGG-8).

    Counts are taken on the line, so one partial aggregation is all that moves.
    """
    on_line = hits(F.col(line), rules.GENERIC_SCAN)
    if python is not None:
        on_line = F.when(python, hits(F.col(line), rules.PYTHON_SCAN)).otherwise(on_line)
    level = lambda s: F.size(F.filter(F.col("_hits"), lambda x: x["severity"] == s))
    counted = code_lines.select(key, on_line.alias("_hits"), F.size(secret_hits(F.col(line))).alias("_secrets"))
    by = counted.groupBy(key).agg(
        F.sum(level("HIGH")).alias("high"),
        F.sum(level("MEDIUM")).alias("medium"),
        F.sum(F.size("_hits") - level("HIGH") - level("MEDIUM")).alias("low"),
        F.sum("_secrets").alias("secrets"),
    )
    return by.withColumn("gate_passed", (F.col("high") == 0) & (F.col("secrets") == 0))


def file_scan(files: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """``files`` with ``security_findings``, ``secrets_found``, ``risk_summary``, ``security_gate_passed``; nothing is shuffled.

    Complexity comes from the functions of a parsed file (``ast``), and is null without any (SCN-7, AGG-9); the
    maintainability index is null, as where its tool is missing (SCN-5).
    """

    def on_lines(make) -> Column:  # noqa: ANN001
        return F.flatten(F.transform(lines(F.col(content)), make))

    def finding(table, tool):  # noqa: ANN001, ANN202
        return on_lines(
            lambda line, i: F.transform(
                hits(line, table),
                lambda x: F.struct(
                    F.lit(tool).alias("tool"), x["severity"].alias("severity"), F.lit("MEDIUM").alias("confidence"), (i + 1).alias("line"),
                    x["issue"].alias("issue"), F.lit("heuristic").alias("test_id"), F.lit("").alias("cwe"),
                ),
            )
        )

    is_python = F.col(language) == "Python"
    secret = on_lines(lambda line, i: F.transform(secret_hits(line), lambda _: F.struct((i + 1).alias("line"), F.lit("possible_secret").alias("type"), F.lit(False).alias("verified"))))
    out = files.withColumns(
        {"security_findings": F.when(is_python, finding(rules.PYTHON_SCAN, "heuristic_python")).otherwise(finding(rules.GENERIC_SCAN, "heuristic")), "secrets_found": secret}
    )
    count = lambda s: F.size(F.filter("security_findings", lambda x: x["severity"] == s))
    found_all = F.size("security_findings")
    out = out.withColumn(
        "risk_summary",
        F.struct(count("HIGH").alias("high"), count("MEDIUM").alias("medium"), (found_all - count("HIGH") - count("MEDIUM")).alias("low"), F.size("secrets_found").alias("secrets")),
    )
    return out.withColumns(
        {
            "security_gate_passed": (F.col("risk_summary.high") == 0) & (F.col("risk_summary.secrets") == 0),
            "complexity_before": complexity(F.transform("ast.functions", lambda f: f["complexity"])) if "ast" in files.columns else F.lit(None).cast("struct<avg_cyclomatic:double,max_cyclomatic:double,function_count:int>"),
            "maintainability_index": F.lit(None).cast("double"),
        }
    )


def complexity(values: Column) -> Column:
    """Average (2 digits), maximum and number of cyclomatic complexities, null if there are none (AGG-9)."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(n > 0, F.struct(F.round(total / n, 2).alias("avg_cyclomatic"), F.array_max(values).cast("double").alias("max_cyclomatic"), n.alias("function_count")))


def io_types(text: Column) -> Column:
    """Kinds of input and output whose signatures occur in the text, in the table's order (IO-1, JOIN-8)."""
    tests = [F.when(F.exists(F.array(*map(F.lit, words)), lambda s: F.contains(text, s)), F.lit(kind)) for kind, words in rules.IO_SIGNATURES.items()]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def import_class(module: Column, language: Column) -> Column:
    """local, stdlib or third_party (IMP-2)."""
    roots = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in rules.STDLIB.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), language), F.array().cast("array<string>"))
    plain = ~F.contains(module, F.lit(".")) & ~F.contains(module, F.lit("-")) & (F.lower(module) == module) & (F.upper(module) != module) & (F.length(module) < 30)
    return F.when(module.startswith("."), "local").when(F.array_contains(roots, F.substring_index(module, ".", 1)), "stdlib").when(plain, "local").otherwise("third_party")


def io_imports(modules: Column) -> Column:
    """Modules whose name has a keyword of input or output (IMP-3)."""
    words = F.array(*map(F.lit, rules.IO_KEYWORDS))
    return F.filter(modules, lambda m: F.exists(words, lambda k: F.contains(F.lower(m), k)))


def io_summary(function_types: Column, modules: Column) -> Column:
    """Which kinds any function has; imports add network and database (AGG-11)."""
    joined = F.array_join(modules, " ")

    def any_of(kind: str, also: bool) -> Column:
        has = F.array_contains(function_types, kind)
        return has | F.exists(F.array(*map(F.lit, rules.IO_SIGNATURES[kind])), lambda s: F.contains(joined, s)) if also else has

    return F.struct(*[any_of(k, k in ("network", "database")).alias(f"has_{k}") for k in rules.IO_SIGNATURES])


