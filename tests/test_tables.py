"""Versioned tables, exactly-once sinks and the joined streams."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codeloom.sources.tables import Conflict, Table
from codeloom.streaming import trace

SCHEMA = StructType([StructField("id", LongType()), StructField("status", StringType())])


@pytest.fixture()
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=8)


def rows(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=repr)


def test_merge_and_delete(spark, table):
    assert rows(table) == []
    assert table.append(spark.createDataFrame([(i, "new") for i in range(40)] + [(None, "none")], SCHEMA)) == 0
    before = table.manifest()["folders"]
    table.merge(spark.createDataFrame([(3, "done"), (99, "added"), (None, "null key")], SCHEMA))
    after = table.manifest()["folders"]
    assert sum(before.get(b) != after[b] for b in after) <= 3  # only touched buckets are written
    assert rows(table) == sorted([(i, "done" if i == 3 else "new") for i in range(40)] + [(99, "added"), (None, "null key")], key=repr)
    table.delete(spark.createDataFrame([(0,), (99,), (12345,), (None,)], "id long"))
    assert rows(table) == sorted(((i, "done" if i == 3 else "new") for i in range(1, 40)), key=repr)
    assert len(rows(table, 0)) == 41 and table.versions() == [0, 1, 2]
    table.merge(table.read().withColumn("status", F.concat("status", F.lit("!"))))  # from itself
    assert rows(table)[0] == (1, "new!") and len(rows(table)) == 39
    table.merge(spark.createDataFrame([], SCHEMA))
    assert len(rows(table)) == 39


def test_last_of_several_rows_of_a_key(spark, table):
    news = spark.createDataFrame([(1, "b"), (1, "c"), (1, "a"), (2, None)], SCHEMA)
    table.merge(news, order="status")
    assert rows(table) == [(1, "c"), (2, None)]


def test_failed_publish_leaves_the_old_version(spark, table, monkeypatch):
    table.append(spark.createDataFrame([(1, "a")], SCHEMA))

    def killed(name, text):
        raise KeyboardInterrupt

    monkeypatch.setattr(table.files, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        table.merge(spark.createDataFrame([(1, "b"), (2, "c")], SCHEMA))
    monkeypatch.undo()
    assert rows(table) == [(1, "a")] and table.versions() == [0]
    table.merge(spark.createDataFrame([(1, "b")], SCHEMA))
    assert rows(table) == [(1, "b")]


def test_two_writers(spark, table):
    table.append(spark.createDataFrame([(1, "a")], SCHEMA))
    old = table.manifest()
    table.append(spark.createDataFrame([(2, "b")], SCHEMA))
    with pytest.raises(Conflict):
        table._publish(old, {}, None)
    assert rows(table) == [(1, "a"), (2, "b")] and table.files.names(f"{table.path}/versions") == ["000000000000.json", "000000000001.json"]


def test_a_batch_counts_once(spark, table):
    sink = table.sink("s")
    sink(spark.createDataFrame([(1, "a")], SCHEMA), 0)
    sink(spark.createDataFrame([(1, "a")], SCHEMA), 0)
    sink(spark.createDataFrame([(2, "b")], SCHEMA), 1)
    sink(spark.createDataFrame([(1, "a")], SCHEMA), 0)
    table.sink("other")(spark.createDataFrame([(3, "c")], SCHEMA), 0)
    assert rows(table) == [(1, "a"), (2, "b"), (3, "c")] and table.manifest()["batches"] == {"s": 1, "other": 0}


def _events(n=400):
    import random

    rng = random.Random(9)
    out, seq = [], 0
    for i in range(n):
        seq += 1
        out.append({"analysis_id": f"a{rng.randrange(5)}", "file": "f", "layer": f"l{rng.randrange(3)}", "type": rng.choice(["layer_start", "layer_end", "file_start"]), "status": "ok", "t": i * 7, "seq": seq})
    return out


def _joined(spark, folder):
    stream = spark.readStream.schema("analysis_id string, file string, layer string, type string, status string, ts timestamp, seq long, nth long").option("maxFilesPerTrigger", 2).json(folder)
    return trace.join_durations(stream, delay="30 minutes", longest="10 minutes")


def test_streams_joined_with_a_kill_and_a_restart(spark, tmp_path, monkeypatch):
    """Several triggers, a batch that dies after its rows are written, a restart: the sink equals the batch join and the windows."""
    kind = "analysis_id string, file string, layer string, type string, status string, t long, seq long"
    events = spark.createDataFrame(_events(), kind).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).drop("t")
    numbered = trace.numbered(events).cache()
    want = {tuple(r) for r in trace.durations(events).where("ended <= started + interval '10 minutes'").collect()}
    assert {tuple(r) for r in trace.join_durations(numbered, longest="10 minutes").collect()} == want and len(want) > 20
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    sink = Table(spark, str(tmp_path / "sink"), _joined_schema(trace.join_durations(numbered)), ["analysis_id"], buckets=4)

    def send(k):
        numbered.where((F.col("seq") > 100 * k) & (F.col("seq") <= 100 * (k + 1))).coalesce(2).write.mode("append").json(folder)

    def run():
        q = _joined(spark, folder).writeStream.foreachBatch(sink.sink("d")).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    send(0)
    send(1)
    run()
    send(2)
    send(3)
    publish, calls = sink.files.publish, []

    def dies_after(name, text):
        publish(name, text)
        calls.append(name)
        raise RuntimeError("killed after publishing")

    monkeypatch.setattr(sink.files, "publish", dies_after)
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.undo()
    run()
    got = [tuple(r) for r in sink.read().collect()]
    assert calls and len(got) == len(set(got)) and set(got) == want


def _joined_schema(df):
    return StructType.fromJson(json.loads(df.schema.json()))
