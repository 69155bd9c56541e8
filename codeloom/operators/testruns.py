"""Test frameworks, their output, regressions and generated stubs (TST-1 to TST-4, AGG-18, FLT-11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import barrier
from .language import lookup
from .structure import js_stubs, python_stubs

# Framework by language where there is no repository, and messages.
BY_LANGUAGE = {"Python": "pytest", "JavaScript": "jest", "TypeScript": "jest", "Java": "junit"}
NO_TESTS = "No tests found. Characterization tests generated — review before committing."
BLOCKED, PASSED = "Regression detected — change blocked.", "All tests passed."


def framework(language: Column, root: Column | None = None) -> Column:
    """Test framework by language, or by a repository's marker files (TST-1).

    ``root`` maps the repository's paths to contents (empty where only the name matters).
    """
    if root is None:
        return F.coalesce(lookup(BY_LANGUAGE, language), F.lit("none"))
    paths = F.map_keys(root)
    has = lambda *names: F.exists(paths, lambda p: p.isin(*names))
    says = lambda name, text: F.coalesce(F.contains(F.try_element_at(root, F.lit(name)), F.lit(text)), F.lit(False))
    tests = F.exists(paths, lambda p: F.regexp_like(p, F.lit(r"(^|/)test_[^/]*\.py$")))
    return (
        F.when(has("pytest.ini") | says("setup.cfg", "[tool:pytest]") | says("pyproject.toml", "pytest") | tests, "pytest")
        .when(has("jest.config.js", "jest.config.ts") | says("package.json", '"jest"'), "jest").when(has("pom.xml", "build.gradle"), "junit")
        .when(has(".mocharc.js", ".mocharc.yml"), "mocha").when(language == "Python", "unittest").otherwise("none")
    )


def parse_output(name: Column, output: Column, returncode: Column) -> Column:
    """Struct of passed, failed, errors from a runner's output; all zero fall back on the return code (TST-3)."""

    def number(regex: str) -> Column:
        return F.coalesce(F.regexp_extract(output, regex, 1).try_cast("int"), F.lit(0))

    py, jest, junit = name.isin("pytest", "unittest"), name == "jest", name == "junit"
    passed = F.when(py, number(r"(\d+) passed")).when(jest, number(r"Tests:\s+(\d+) passed")).when(junit, number(r"Tests run:\s*(\d+)")).otherwise(0)
    failed = F.when(py | jest, number(r"(\d+) failed")).when(junit, number(r"Failures:\s*(\d+)")).otherwise(0)
    errors = F.when(py, number(r"(\d+) error")).otherwise(0)
    silent = (passed == 0) & (failed == 0) & (errors == 0)
    ok = returncode == 0
    return F.struct(
        F.when(silent & ok, 1).otherwise(passed).alias("passed"), F.when(silent & ~ok, 1).otherwise(failed).alias("failed"), errors.alias("errors"),
        returncode.alias("returncode"),
    )


def regression(baseline: Column, modified: Column) -> Column:
    """More failures and errors than before (AGG-18)."""
    bad = lambda r: F.coalesce(r["failed"], F.lit(0)) + F.coalesce(r["errors"], F.lit(0))
    return bad(modified) > bad(baseline)


def _compiles(content: pd.Series) -> pd.Series:
    def one(text: str | None) -> bool:
        try:
            compile(text or "", "source", "exec", dont_inherit=True)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return content.map(one).astype(bool)


def compile_check(language: Column, content: Column) -> Column:
    """The single-file test: Python text must compile (it is never run), others have no tests (TST-2).

    The time is the constant that is reported for such a check, not a measurement.
    """
    python = language == "Python"
    ok = barrier(F.pandas_udf(_compiles, "boolean"))(F.when(python, content).otherwise(""))
    return F.struct(
        F.when(python & ok, 1).otherwise(0).alias("passed"), F.when(python & ~ok, 1).otherwise(0).alias("failed"), F.lit(0).alias("errors"),
        F.when(python, 100).otherwise(0).alias("execution_time_ms"),
    )


def stubs(language: Column, content: Column, product: str = "codeloom") -> Column:
    """Characterisation tests to start from, up to five functions (TST-4)."""
    py = F.transform(
        python_stubs(content),
        lambda f: F.concat(
            F.lit("def test_"), f["name"], F.lit("_exists():\n    # TODO: verify "), f["name"], F.lit("("), F.array_join(F.transform(f["params"], lambda _: F.lit("None")), ", "),
            F.lit(") returns expected value\n    pass\n"),
        ),
    )
    js = F.transform(js_stubs(content), lambda n: F.concat(F.lit("test('"), n, F.lit(" exists', () => {\n  // TODO: assert "), n, F.lit("() returns expected value\n});\n")))
    head_py = f"# AUTO-GENERATED by {product} — characterization tests\n# Review and add real assertions before committing\nimport pytest\n\n"
    head_js = f"// AUTO-GENERATED by {product} — characterization tests\n\n"
    return (
        F.when((language == "Python") & (F.size(py) == 0), "# No functions detected for characterization").when(language == "Python", F.concat(F.lit(head_py), F.array_join(py, "\n")))
        .when(language.isin("JavaScript", "TypeScript") & (F.size(js) == 0), "// No functions detected for characterization")
        .when(language.isin("JavaScript", "TypeScript"), F.concat(F.lit(head_js), F.array_join(js, "\n"))).otherwise("# No test generation available for this language")
    )


def run(language: Column, original: Column, modified: Column) -> Column:
    """The test record of one file without a repository."""
    name = framework(language)
    before, after = compile_check(language, original), compile_check(language, modified)
    none = name == "none"
    zero = F.struct(F.lit(0).alias("passed"), F.lit(0).alias("failed"), F.lit(0).alias("errors"), F.lit(0).alias("execution_time_ms"))
    worse = ~none & regression(before, after)
    return F.struct(
        F.when(none, "auto-generated").otherwise(name).alias("framework_detected"), F.when(none, zero).otherwise(before).alias("baseline_results"),
        F.when(none, zero).otherwise(after).alias("modified_results"), worse.alias("regression_detected"),
        F.when(none, stubs(language, original)).alias("auto_generated_tests"), F.when(none, NO_TESTS).when(worse, BLOCKED).otherwise(PASSED).alias("message"),
    )


def unless_regression(changes: Column, worse: Column) -> Column:
    """The validated changes that go on: none after a regression, though the raw ones are still stored (FLT-11)."""
    valid = F.filter(changes, lambda c: F.coalesce(c["status"] == "validated", F.lit(False)))
    return F.when(F.coalesce(worse, F.lit(False)), F.slice(valid, 1, 0)).otherwise(valid)


__all__ = ["compile_check", "framework", "parse_output", "regression", "run", "stubs", "unless_regression"]
