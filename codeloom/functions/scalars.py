"""Small scalar functions of the views and records (MTH-2, STR-FN-7, STR-FN-8, DTE-1, MAP-1, SET-5, SET-6, AGG-22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves upwards (also below zero)."""
    return F.floor(x + F.lit(0.5))


def fixed(x: Column, digits: int = 1) -> Column:
    """With so many digits, as text."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def kilobytes(size: Column) -> Column:
    """A size in whole kilobytes, halves upwards."""
    return round_half_up(size / 1024)


def byte_length(text: Column) -> Column:
    """Length in UTF-8."""
    return F.octet_length(text)


def short_id(value: Column) -> Column:
    """The first eight characters of an id."""
    return F.left(value.cast("string"), F.lit(8))


def shown_time(iso: Column) -> Column:
    """An ISO time to the second, with a space for the T."""
    return F.replace(F.substring(iso, 1, 19), F.lit("T"), F.lit(" "))


def expiry(start: Column, minutes: int) -> Column:
    """A time so many minutes later."""
    return start + F.make_interval(mins=F.lit(minutes))


def get(table: Column, key: Column, default: Column) -> Column:
    """A map's value, or a default."""
    return F.coalesce(F.try_element_at(table, key), default)


def merge(left: Column, right: Column) -> Column:
    """Two maps in one, the right one's values for keys of both; no setting of the session is needed."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def toggle(chosen: Column, item: Column) -> Column:
    """A selection with an item put in, or taken out if it was there (SET-6)."""
    return F.when(F.array_contains(chosen, item), F.array_remove(chosen, item)).otherwise(F.array_append(chosen, item))


def toggle_all(chosen: Column, every: Column) -> Column:
    """Everything, or nothing if everything was chosen."""
    return F.when(F.size(F.array_except(every, chosen)) == 0, F.slice(every, 1, 0)).otherwise(every)


def together(*frames: DataFrame) -> DataFrame:
    """Findings of several tools, or changes of several files, one after the other (SET-5)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
