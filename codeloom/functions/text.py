"""Text functions with the semantics of Python's ``str`` and ``re``, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``str.splitlines`` splits at.
LINE_ENDS = r"(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}])"


def pattern(regex: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """A Python regular expression for Spark: Unicode classes, and line feeds are all that ``.`` leaves out and ``^`` follows."""
    return f"(?Ud{'i' if ignore_case else ''}{'m' if multiline else ''}){regex}"


def found(text: Column, regex: str, ignore_case: bool = False, multiline: bool = False) -> Column:
    """Whether the expression is found anywhere in the text."""
    return F.regexp_like(text, F.lit(pattern(regex, ignore_case, multiline)))


def lines(text: Column) -> Column:
    """The text's lines without their ends; an end at the very end starts no line."""
    body = F.regexp_replace(text, f"{LINE_ENDS}\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_ENDS, -1))


def pieces(text: Column) -> Column:
    """The text's lines with their ends, as ``splitlines(keepends=True)``; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).*?{LINE_ENDS}|.+\z"), F.lit(0))


def quoted(text: Column) -> Column:
    """A text as Python shows it, with its quotes and the usual escapes."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def feed_lines(text: Column) -> Column:
    """The text's parts between line feeds, as ``split("\\n")``: an empty text is one line, and a line feed at the very end starts another."""
    return F.split(text, "\n", -1)


def n_lines_parser(text: Column) -> Column:
    """Number of line feeds plus one, the parser's notion of lines (0 for blank text)."""
    return F.when(strip(text) == "", 0).otherwise(occurrences(text, F.lit("\n")) + 1)


def strip(text: Column) -> Column:
    """The text without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part, as ``str.count``."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(F.lit(0))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def barrier(udf):  # noqa: ANN001, ANN201
    """A pandas UDF that the optimizer won't copy into other expressions: it must be worked out once, and can't be inside lambdas."""
    return udf.asNondeterministic()
