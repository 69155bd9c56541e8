"""The stream gives what the batch gives, in whatever order events arrive."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.streaming import trace

T0 = datetime(2024, 1, 1)


def _events():
    out, seq = [], 0
    for a in ("x", "y"):
        for layer in ("language_detector", "ast_parser", "risk_scorer"):
            for k in range(2):
                for kind in ("layer_start", "layer_end"):
                    seq += 1
                    if (a, layer, k, kind) != ("y", "ast_parser", 1, "layer_start"):
                        out.append({"analysis_id": a, "type": kind, "layer": layer, "status": "success" if kind == "layer_end" else None, "ts": (T0 + timedelta(milliseconds=37 * seq)).isoformat(), "file": f"f{k}", "seq": seq})
    return out


@pytest.mark.parametrize("backwards", [False, True])
def test_stream_equals_batch(spark, tmp_path, backwards):
    events = _events()
    lots = [events[i::4] for i in range(4)]
    (tmp_path / "in").mkdir()
    for i, lot in enumerate(lots):
        (p := tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, lot)))
        os.utime(p, (1_700_000_000 + (-i if backwards else i) * 60,) * 2)
    got = []
    stream = trace.stream_durations(trace.read_stream(spark, str(tmp_path / "in"), 1))
    q = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = trace.durations(spark.read.schema(stream_schema(spark)).json(str(tmp_path / "in"))).collect()
    key = lambda r: (r.analysis_id, r.file, r.layer, r.status, r.duration_ms)
    assert sorted(map(key, got)) == sorted(map(key, batch)) and len(batch) == 11


def stream_schema(spark):
    from codeloom import schemas

    return schemas.TRACE


def test_files_and_labels(spark):
    rows = [("a", "file_start", None, None, 0, T0, "f1", 1), ("a", "layer_start", "ast_parser", None, 0, T0, None, 2), ("a", "layer_end", "ast_parser", "error", 5, T0 + timedelta(microseconds=1999), None, 3)]
    df = trace.with_file(spark.createDataFrame(rows, "analysis_id string, type string, layer string, status string, duration_ms long, ts timestamp, file string, seq long"))
    r = trace.durations(df).first()
    assert (r.file, r.duration_ms, r.status) == ("f1", 1, "error")
    none = F.lit(None).cast("string")
    shown = [x.s for x in df.orderBy("seq").select(trace.label(F.col("type"), F.col("file"), F.col("duration_ms"), F.col("status"), none, F.array().cast("array<string>")).alias("s")).collect()]
    assert shown == ["Processing f1", "Starting...", "Done (5ms) ❌"]
    assert spark.range(1).select(trace.layer_label(F.lit("ast_parser")), trace.layer_label(F.lit("odd"))).first()[:] == ("AST Parsing", "odd")
    raw = spark.createDataFrame([('{"analysis_id": "q", "type": "layer_start", "seq": 4}',)], "value string")
    assert trace.events(raw).first().seq == 4


def test_fan_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, _events())))
    seen = {}
    q = trace.fan_out(trace.read_stream(spark, str(tmp_path / "in")), lambda df, _: seen.update({r.analysis_id: r["count"] for r in df.groupBy("analysis_id").count().collect()}), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == {"x": 12, "y": 11}


def test_state_partitions(spark, tmp_path):
    """State partitions follow the events, and the session's own number is as before once a stream has started."""
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "200")
    try:
        assert [trace.state_partitions(spark, n) for n in (0, 1_000, 6_000_000, 10**9)] == [4, 4, 24, 200]
        spark.range(10).write.parquet(f"{tmp_path}/in")
        ids = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").dropDuplicates(["id"])
        query = trace.fan_out(ids, lambda rows, _: rows.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", partitions=3)
        query.awaitTermination()
        assert spark.conf.get(name) == "200" and spark.read.parquet(f"{tmp_path}/out").count() == 10
        assert len([p for p in (tmp_path / "checkpoint/state/0").iterdir() if p.name.isdigit()]) == 3
    finally:
        spark.conf.set(name, before)
