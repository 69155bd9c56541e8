"""Parents with their children as arrays of bounded length (JOIN-1, JOIN-2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], salt: Column, rows: int = 10_000) -> DataFrame:
    """``parents`` with ``part``, ``parts`` and ``children``: an array of structs of ``fields`` in their order.

    A parent of at most ``rows`` children has one row (an empty array without any). One of more, be it a third of all children, has as many
    parts as they need, dealt by ``salt``, a whole number of the child: counts come first, so no task ever holds more than a part. Children
    without a parent are left out, as are those with a null key.
    """
    children = children.select(F.col(key).alias("_own"), *fields, salt.cast("long").alias("_salt"))
    counts = children.where("_own IS NOT NULL").groupBy(F.col("_own").alias("_key")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("long").alias("parts"))
    salted = children.join(counts, F.col("_own") == F.col("_key")).withColumn("part", F.pmod("_salt", "parts"))
    parts = salted.groupBy("_key", "part", "parts").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("children"))
    got = parents.join(parts, F.col(key) == F.col("_key"), "left")
    empty = F.array().cast(dict(parts.dtypes)["children"])
    return got.select(*parents.columns, F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("children", empty).alias("children"))
