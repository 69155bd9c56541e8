"""SparkSession settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI arithmetic (errors aren't nulls), UTC, AQE with skew handling; all of them are Spark 4 defaults but the zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Rows and bytes that go to a Python worker at a time, Spark's own numbers last. A batch's parse trees and diffs are many times its texts, and
#: with 10,000 files a batch it takes all files of a task.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("100", "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("4m", "67108864b")}


def small_batches(spark: SparkSession) -> None:
    """Send Python workers few files at a time from now on; a session that has its own numbers keeps them, but for more than 100 rows."""
    rows, size = BATCHES
    if not 0 < int(spark.conf.get(rows)) <= int(BATCHES[rows][0]):
        spark.conf.set(rows, BATCHES[rows][0])
    if spark.conf.get(size, BATCHES[size][1]) == BATCHES[size][1]:
        spark.conf.set(size, BATCHES[size][0])


def session(name: str = "codeloom", **settings: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``settings`` (with ``__`` for dots) go over them."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
