"""The engine's functions for SQL, as temporary functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession

from ..operators.edits import _DIFF, _diff_batch
from ..operators.structure import parse_source
from .text import LINE_ENDS


def register(spark: SparkSession) -> list[str]:
    """Register ``code_lines``, ``code_occurrences``, ``code_diff`` and ``code_functions``; returns their names."""
    ends = LINE_ENDS.replace("\\", "\\\\")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION code_lines(t STRING) RETURNS ARRAY<STRING>
        RETURN CASE WHEN t = '' THEN array() ELSE split(regexp_replace(t, '{ends}\\\\z', ''), '{ends}', -1) END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION code_occurrences(t STRING, part STRING) RETURNS INT
        RETURN CASE WHEN part = '' THEN 0 ELSE CAST((length(t) - length(replace(t, part, ''))) / length(part) AS INT) END"""
    )
    from pyspark.sql import functions as F

    def names(content: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([[f["name"] for f in parse_source(c, k)["functions"]] for c, k in zip(content, language, strict=True)])

    spark.udf.register("code_diff", F.pandas_udf(_diff_batch, _DIFF))
    spark.udf.register("code_functions", F.pandas_udf(names, "array<string>"))
    return ["code_lines", "code_occurrences", "code_diff", "code_functions"]
