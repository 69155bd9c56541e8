"""The trace of pipeline events, in batches and as a stream (STR-1 to STR-5)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules, schemas
from ..operators.language import lookup

KEYS = ("analysis_id", "file", "layer")
_PAIRS = "analysis_id string, file string, layer string, status string, started timestamp, ended timestamp, duration_ms long"


def events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Trace events from JSON text (STR-1); for batch and stream alike."""
    return raw.select(F.from_json(F.col(column), schemas.TRACE).alias("e")).select("e.*")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of trace events from a folder of JSON lines."""
    return spark.readStream.schema(schemas.TRACE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def with_file(trace: DataFrame) -> DataFrame:
    """Every event with the file of the last file_start before it; only that event names the file."""
    so_far = Window.partitionBy("analysis_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("type") == "file_start", F.col("file")), ignorenulls=True).over(so_far)
    return trace.withColumn("file", F.coalesce("file", last))


def durations(trace: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each end with the start just before it in its layer: duration in whole milliseconds (STR-2)."""
    layer = trace.where(F.col("type").isin("layer_start", "layer_end"))
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    paired = layer.withColumns({"_type": F.lag("type").over(order), "started": F.lag("ts").over(order)})
    ended = paired.where((F.col("type") == "layer_end") & (F.col("_type") == "layer_start"))
    ms = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000)
    return ended.select(*keys, "status", "started", F.col("ts").alias("ended"), ms.cast("long").alias("duration_ms"))


def by_layer(trace: DataFrame) -> DataFrame:
    """Events and errors a layer."""
    ended = F.col("type") == "layer_end"
    return trace.groupBy("layer").agg(F.count(F.lit(1)).alias("events"), F.count_if(ended).alias("ended"), F.count_if(ended & (F.col("status") == "error")).alias("errors"))


def _pair(held: list, final: bool) -> tuple[list, list]:
    """Pairs of a start and the end after it, and what still waits for its other half; events as (seq, ts, type, status).

    Only neighbours in sequence (start n, end n + 1) are sure to be a pair before all events are in.
    """
    held = sorted(held)
    pairs, rest, i = [], [], 0
    while i < len(held):
        a, b = held[i], held[i + 1] if i + 1 < len(held) else None
        if b and a[2] == "layer_start" and b[2] == "layer_end" and (final or b[0] == a[0] + 1):
            pairs.append((a, b))
            i += 2
        else:
            rest.append(a)
            i += 1
    return pairs, [] if final else rest


def stream_durations(trace: DataFrame, delay: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """:func:`durations` of a stream whose events may come in any order.

    A layer's unmatched events wait in its state; its start and end carry consecutive numbers (``seq``). What
    has no other half ``wait_ms`` after its time is paired as it stands and forgotten, so the state is bounded.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            for pdf in frames:
                micros = pdf["ts"].astype("datetime64[us]").astype("int64")
                held += [(int(s), int(t), k, v) for s, t, k, v in zip(pdf["seq"], micros, pdf["type"], pdf["status"], strict=True)]
        pairs, rest = _pair(held, state.hasTimedOut)
        if rest:
            state.update((json.dumps(rest),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), max(x[1] for x in rest) // 1000) + wait_ms)
        elif state.exists:
            state.remove()
        out = [(*key, b[3], pd.Timestamp(a[1], unit="us"), pd.Timestamp(b[1], unit="us"), (b[1] - a[1]) // 1000) for a, b in pairs]
        yield pd.DataFrame(out, columns=["analysis_id", "file", "layer", "status", "started", "ended", "duration_ms"])

    layer = trace.where(F.col("type").isin("layer_start", "layer_end")).withWatermark("ts", delay)
    return layer.groupBy(*KEYS).applyInPandasWithState(step, _PAIRS, "held string", "append", "EventTimeTimeout")


def numbered(trace: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Layer events with ``nth``, their place in their layer, as a producer counts them."""
    layer = trace.where(F.col("type").isin("layer_start", "layer_end"))
    return layer.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "seq")).cast("long"))


def join_durations(trace: DataFrame, delay: str = "10 minutes", longest: str = "1 day", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """:func:`durations` as a join of the stream of starts with the stream of ends (STR-2, STR-3), for batches too.

    ``trace`` has ``nth`` of :func:`numbered`: a start and the end just after it carry consecutive numbers, so both sides are spread by
    all of their key. The state stays in the JVM and is bounded: a start waits ``longest`` for its end, an end ``delay`` for its start.
    """
    starts = trace.where("type = 'layer_start'").select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("nth") + 1).alias("_nth"), F.col("ts").alias("started"))
    ends = trace.where("type = 'layer_end'").select(*keys, "status", "nth", F.col("ts").alias("ended"))
    if trace.isStreaming:
        starts, ends = starts.withWatermark("started", delay), ends.withWatermark("ended", delay)
    same = [F.col(f"_{k}") == F.col(k) for k in keys]
    near = (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL '{longest}'"))
    both = starts.join(ends, [*same, F.col("_nth") == F.col("nth"), near])
    ms = F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1000).cast("long")
    return both.select(*keys, "status", "started", "ended", ms.alias("duration_ms"))


def state_partitions(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """State partitions for so many events: one for ``each``, at least one a core, at most as many as the session's shuffles have.

    Every micro-batch opens and commits the state stores of all of them, the empty ones too.
    """
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-rows // each))))


def fan_out(trace: DataFrame, sinks: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, partitions: int | None = None):  # noqa: ANN201
    """Hand every micro-batch to ``sinks`` (STR-3, SNK-8); ``every`` is the poll interval (STR-5), all there is and stop without it.

    ``partitions`` is the number of state partitions, which a checkpoint keeps from its first start; the session's number of shuffle partitions without it.
    """
    writer = trace.writeStream.foreachBatch(sinks).option("checkpointLocation", checkpoint)
    conf, name = trace.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    try:
        if partitions:
            conf.set(name, partitions)  # a stream takes the settings of its start
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        conf.set(name, before)


def label(kind: Column, file: Column, duration: Column, status: Column, message: Column, issues: Column) -> Column:
    """What a viewer shows for an event (STR-4)."""
    done = F.concat(F.lit("Done ("), duration.cast("string"), F.lit("ms)"), F.when(status == "error", " ❌").otherwise(" ✓"))
    return (
        F.when(kind == "file_start", F.concat(F.lit("Processing "), F.coalesce(F.nullif(file, F.lit("")), F.lit("..."))))
        .when(kind == "pipeline_complete", "Pipeline complete")
        .when(kind == "validation_failed", F.concat(F.lit("Validation failed: "), F.array_join(F.coalesce(issues, F.array().cast("array<string>")), ", ")))
        .when(kind == "regression_blocked", F.coalesce(F.nullif(message, F.lit("")), F.lit("Regression blocked")))
        .when(kind == "layer_start", "Starting...").when(kind == "layer_end", done).otherwise(F.coalesce(F.nullif(message, F.lit("")), kind, F.lit("")))
    )


def layer_label(layer: Column) -> Column:
    """A layer's name for people; unknown ones by themselves."""
    return F.coalesce(lookup(rules.LAYER_LABELS, layer), layer, F.lit("System"))
