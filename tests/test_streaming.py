"""Streams into tables."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.types import Kind
from tidemark.operators.compact import Compactor
from tidemark.operators.engine import Engine
from tidemark.operators.sinks import FileSink
from tidemark.streaming.ingest import compact_on, counted_by_window, event_columns, file_stream, ingest_messages, ingest_notified, ingest_stream, matches, parse_messages, sessions


@pytest.mark.parametrize(("subject", "pattern", "fits"), [("event.a", "event.a", True), ("event.a", "event.*", True), ("event.a.b", "event.*", False), ("event.a.b", "event.>", True), ("eventXa", "event.a", False), ("a+b", "a+b", True)])
def test_subjects(spark, subject, pattern, fits):
    assert spark.range(1).select(matches(F.lit(subject), pattern)).first()[0] is fits


def test_messages(spark):
    df = spark.createDataFrame([("s", '[{"event":"e1","n":1.5,"b":true,"o":{"k":[1]},"z":null},{"event":"e2"}]'), ("s", "not json"), ("s", None)], "subject string, value string")
    rows = event_columns(parse_messages(df), {"event": Kind.STRING, "n": Kind.FLOAT64, "b": Kind.BOOL, "o": Kind.JSON, "z": Kind.INT64}).collect()
    assert sorted(map(tuple, rows), key=repr) == [("e1", 1.5, True, '{"k":[1]}', None), ("e2", None, None, None, None)]


def test_messages_without_a_schema(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"subject": "event.x", "value": '[{"event":"event1","text":"hi","n":2}]'}) + "\n" + json.dumps({"subject": "other", "value": '[{"event":"event2"}]'}))
    engine = Engine(spark, str(tmp_path / "hot"))
    engine.add_table("event", hash_by="event", sort_by="n")
    stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "subject string, value string").schema, "json")
    ingest_messages(engine, stream, {"event.>": "event"}, str(tmp_path / "c")).awaitTermination()
    assert [tuple(r) for r in engine.scan("event", ["event", "text", "n"], ["event == 'event1'"]).collect()] == [("event1", "hi", 2.0)]
    assert engine.tables["event"].frame().count() == 1
    engine.close()


def test_only_new_files_are_read(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "hot"))
    table = engine.add_table("t", hash_by="k", sort_by="n")
    rows = spark.range(10).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").alias("n"))
    for expected in (10, 20):
        rows.write.mode("append").orc(str(tmp_path / "in"))
        ingest_stream(engine, file_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "c"), source="orc").awaitTermination()
        assert table.frame().count() == expected
    engine.close()


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    """A micro-batch that comes again, as after a failure before its commit, finds its rows there."""
    engine = Engine(spark, str(tmp_path / "hot"))
    table = engine.add_table("t", hash_by="k", sort_by="n")
    rows = spark.range(10).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").alias("n"))
    rows.write.orc(str(tmp_path / "in"))

    def run():
        ingest_stream(engine, file_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "c"), source="orc").awaitTermination()

    run()
    for commit in (tmp_path / "c" / "commits").iterdir():
        commit.unlink()
    run()
    assert table.frame().count() == 10 and len(table.batches()) == 1
    engine.close()


def test_notified_objects(spark, tmp_path):
    """A queue's messages name the objects to read; other events, extensions and repeats add nothing."""
    def record(name, event="ObjectCreated:Put"):
        return {"eventName": event, "s3": {"bucket": {"name": "b"}, "object": {"key": name}}}

    (tmp_path / "b").mkdir()
    spark.createDataFrame([("x", 1)], "k string, n long").toPandas().to_parquet(tmp_path / "b" / "one two.parquet")
    (tmp_path / "b" / "three.csv").write_text("k,n\ny,2\n")
    bodies = [{"Records": [record("one+two.parquet"), record("three.csv"), record("gone.parquet", "ObjectRemoved:Delete")]}, {"Records": [record("three.csv"), record("notes.txt")]}, {"Event": "test"}]
    (tmp_path / "queue").mkdir()
    (tmp_path / "queue" / "1.json").write_text("\n".join(json.dumps({"value": json.dumps(b)}) for b in bodies))
    engine = Engine(spark, str(tmp_path / "hot"))
    table = engine.add_table("t", hash_by="k", sort_by="n")
    stream = file_stream(spark, str(tmp_path / "queue"), spark.createDataFrame([], "value string").schema, "json")
    ingest_notified(engine, stream, str(tmp_path / "c"), pattern=str(tmp_path) + "/{bucket}/{key}").awaitTermination()
    assert sorted(r.k for r in table.scan(["k"]).collect()) == ["x", "y"] and engine.log.frame().where("message like '%txt%'").count() == 1
    engine.close()


def drained(stream, tmp_path, mode="append"):
    """All rows that a stream over what is there now gives."""
    out = []
    stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_watermark(spark, tmp_path):
    """A window is given once it is over, and rows that come later than the watermark don't count."""
    def write(name, rows):
        spark.createDataFrame(rows, "t string, k string").selectExpr("cast(t as timestamp) as t", "k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    parts = [[("2024-01-01 00:01", "a"), ("2024-01-01 00:05", "a"), ("2024-01-01 00:31", "b")], [("2024-01-01 02:00", "a")], [("2024-01-01 00:02", "a")], [("2024-01-01 05:00", "a")]]
    out = []
    for rows in parts:
        write("x", rows)
        stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "t timestamp, k string").schema, "parquet")
        out += drained(counted_by_window(stream, "t", ["k"], "30 minutes", "10 minutes"), tmp_path)
    got = sorted((str(r.start), r.k, r.n) for r in out)
    assert got == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:30:00", "b", 1), ("2024-01-01 02:00:00", "a", 1)]


def test_sessions_in_state(spark, tmp_path):
    """Sessions that go over micro-batches, against a plain loop."""
    rows = [("u1", 0), ("u1", 50), ("u2", 10), ("u1", 500), ("u1", 520), ("u2", 20), ("u1", 2000), ("u2", 900)]
    out = []
    for part in (rows[:3], rows[3:6], rows[6:]):
        spark.createDataFrame(part, "k string, s long").selectExpr("k", "timestamp_seconds(s) as t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "k string, t timestamp").schema, "parquet")
        out += drained(sessions(stream, "t", "k", 100), tmp_path)
    assert sorted((r.k, int(r.start.timestamp()), int(r.end.timestamp()), r.n) for r in out) == [("u1", 0, 50, 2), ("u1", 500, 520, 2), ("u2", 10, 20, 2)]


def test_compaction_on_a_trigger(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "hot"))
    table = engine.add_table("t", hash_by="k", sort_by="k")
    table.append(spark.createDataFrame([("a",)], "k string"))
    query = compact_on(spark.readStream.format("rate").load(), Compactor(table, FileSink(directory=str(tmp_path / "out"))), str(tmp_path / "c"), "1 second")
    for _ in range(60):
        if not table.frame().count():
            break
        time.sleep(0.5)
    query.stop()
    assert spark.read.orc(str(tmp_path / "out")).count() == 1
    engine.close()
