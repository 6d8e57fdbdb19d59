"""Sources, transformations, tables, scans, compaction, sinks, streams and the system tables."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.config import Store, from_env, parse
from tidemark.functions.schema import Schema
from tidemark.functions.scripting import Computed, Stats, hardware_address, limited, load
from tidemark.functions.types import Kind
from tidemark.functions.values import row_hash
from tidemark.operators.compact import Compactor
from tidemark.operators.engine import Engine
from tidemark.operators.scan import FilterError, epoch_seconds, pages, parse_filters, read_page, time_range
from tidemark.operators.sinks import AccountsSink, ConsoleSink, FileSink, MessageSink, MultiSink, NoopSink, PeerSink, S3Sink, Sink, encoder, make_sink
from tidemark.operators.system import LogTable, duration
from tidemark.operators.transform import merge, normalise, transform
from tidemark.plans.catalogue import QUERIES
from tidemark.sources.readers import find_column, first, from_csv, from_events, from_orc, from_request, from_rows, from_url, rows

EVENTS = [{"d": "event1", "a": 10, "b": 20}, {"d": "event1", "b": 20}, {"d": "event2"}, {"d": "event2"}, {"d": "event3", "a": "1234", "e": {"name": "roman"}}]


def values(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "hot"))
    yield e
    e.close()


def test_ragged_events(spark):
    df = from_events(spark, [{"a": 1, "b": 2}, {"a": 1, "c": "hi"}, {"b": 1, "c": "hi", "d": 1.5}, {"/x": 1, "a": None}])
    assert [tuple(r) for r in df.collect()] == [(1, 2, None, None), (1, None, "hi", None), (None, 1, "hi", 1.5), (None, None, None, None)]
    assert from_events(spark, [{"n": 1}], json_numbers=True).first().n == 1.0
    assert from_events(spark, []).count() == 0


def test_rows_as_events(spark):
    df = spark.sql("select 1 as n, cast(2 as tinyint) as i, 1.5f as f, 'hi' as s, true as b, map('k', 1, 'no', null) as m, array(named_struct('a', null)) as l, date'2024-01-02' as d, timestamp'2024-01-02 03:04:05.000006' as t, cast(null as string) as z, 3 as `/x`")
    out = from_rows(df.union(df.selectExpr(*(f"cast(null as {t}) as `{c}`" for c, t in df.dtypes))))
    event = df.drop("m", "l").first().asDict() | {"m": {"k": 1, "no": None}, "l": [{"a": None}]}
    expected = from_events(spark, [event]).first().asDict() | {"z": None}
    assert [r.asDict() for r in out.orderBy("n", ascending=False).collect()] == [expected, dict.fromkeys(expected)]
    assert [f.name for f in out.schema if f.metadata] == ["l", "m"]


def test_events_list_keeps_rows_off_the_driver(spark, tmp_path):
    found = []
    for n, value in enumerate(("cast(1 as double)", "cast(null as double)")):
        folder = str(tmp_path / str(n))
        spark.sql(f"select 1L as event_id, 2L as user_id, 'a' as event_type, {value} as value, cast(null as string) as props, timestamp_ntz'2024-03-10 02:30:00' as ts").where(f"{n} = 0 or event_id = 2").write.parquet(f"{folder}/events.parquet")
        df = QUERIES["events_list"](spark, folder)
        assert df.inputFiles() and sorted(df.columns) == ["event_id", "event_type", "props", "ts", "user_id", "value"]
        found += df.select("event_id", "value", "props", F.col("ts").cast("string")).collect()
    assert found == [(1, 1.0, None, "2024-03-10 02:30:00")]


def test_transform(spark):
    df = spark.createDataFrame([("x", 5, 7)], "a string, b long, c int")
    out = transform(normalise(df), Schema({"b": Kind.INT64, "c": Kind.STRING, "data": Kind.JSON}), [Computed("data", Kind.JSON, "to_json(struct(a))"), Computed("none", Kind.INT32, "b")])
    assert sorted(out.columns) == ["b", "data"] and out.first().data == '{"a":"x"}'


def test_computed_columns_see_the_input(spark):
    df = spark.createDataFrame([(2,)], "a long")
    out = transform(df, None, [Computed("a", Kind.INT64, "a * 10"), Computed("b", Kind.INT64, "a * 10"), Computed("bad", Kind.INT64, "concat('x', a)")])
    assert tuple(out.select("a", "b", "bad").first()) == (20, 20, None)


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("cur,amt,emps\nEUR,1,\nUSD,x,5\nCAD,3,\n,4,1\n")
    df = from_csv(spark, str(path), Schema({"amt": Kind.INT64}))
    assert values(df) == [("", 4, "1"), ("CAD", 3, ""), ("EUR", 1, ""), ("USD", None, "5")]
    path.write_text("a,b\n1\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        from_csv(spark, str(path)).collect()


def test_orc_kinds(spark, tmp_path):
    path = str(tmp_path / "x.orc")
    spark.sql("select true as boolean1, cast(1 as byte) as byte1, cast(1 as short) as short1, 65536 as int1, 9223372036854775807 as long1, cast(1.0 as float) as float1, 2.0d as double1, cast('x' as binary) as bytes1, 'hi' as string1, named_struct('list', array(1)) as middle, array(named_struct('int1', 3)) as list, map('k', 1) as map").write.orc(path)
    df = from_orc(spark, path)
    assert len(df.columns) == 9 and json.loads(df.first()["list"]) == [{"int1": 3}] and df.first()["map"] == '{"k":1}'


def test_requests(spark):
    assert from_request(spark, {}) is None
    assert from_request(spark, {"batch": EVENTS}).count() == 5
    with pytest.raises(ValueError, match="extension"):
        from_url(spark, "/x/y.txt")
    with pytest.raises(ValueError, match="unsupported request"):
        from_request(spark, {"avro": "x"})
    df = spark.range(3)
    assert first(df, ["id"]) is not None and len(list(rows(df))) == 3
    assert find_column(df, "ID") == "id" and find_column(df, "ID", exact=True) is None


def test_append_and_scan(engine):
    table = engine.add_table("t", hash_by="d", sort_by="b", schema_text="{a: bigint, b: bigint, d: string, e: json, another: bigint}")
    assert engine.ingest({"batch": EVENTS})["t"]
    assert values(engine.scan("t", ["d", "a", "b"], ["d == 'event1'"])) == [("event1", 10, 20), ("event1", None, 20)]
    assert values(table.scan(["a", "e", "another"], ["event3"])) == [(1234, '{"name": "roman"}', None)]
    assert engine.ingest([{"x": 1}]) == {"t": None}
    assert engine.ingest(EVENTS, ["unknown"]) == {}
    with pytest.raises(ValueError, match="no column"):
        table.scan(["nope"])
    with pytest.raises(FilterError, match="must contain 'd' constraint"):
        engine.scan("t", ["a"], ["b >= 1"])
    assert table.scan(["a"], []).count() == 0


def test_schema_of_the_last_batch(engine, spark):
    table = engine.add_table("t", hash_by="k", sort_by="t")
    table.append(spark.createDataFrame([("0123", 1)], "k string, t long"))
    table.append(spark.createDataFrame([("123", 2, 0.5), (None, 3, 1.0), ("", 4, 1.0)], "k string, t long, x double"))
    assert table.latest_schema().columns() == ["k", "t", "x"]
    assert values(table.scan(["k", "t", "x"])) == [("0123", 1, None), ("123", 2, 0.5)]
    assert values(table.scan(["t"], ["123"], [(2, 3)])) == [(2,)] and table.scan(["t"], ["123"], [(1, 2)]).count() == 0
    assert engine.sql("select count(*) as n from t where k = '123'").first().n == 1


def test_pruning(engine, spark):
    table = engine.add_table("t", hash_by="k", sort_by="t")
    table.append(spark.range(100).select((F.col("id") % 5).cast("string").alias("k"), F.col("id").alias("t"), F.lit(1).alias("x")))
    plan = table.scan(["x"], ["3"], [(10, 50)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan and "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t,10), LessThan(t,50)]" in plan
    assert "ReadSchema: struct<t:bigint,x:int>" in plan and "Exchange" not in plan
    assert table.scan(["x"], ["3"], [(10, 50)]).count() == 8


def test_odd_hash_values(engine, spark):
    table = engine.add_table("t", hash_by="k", sort_by="k")
    odd = ["a/b", "x=y", "ü 1", "%41", "__HIVE_DEFAULT_PARTITION__x"]
    table.append(spark.createDataFrame([(v,) for v in odd], "k string"))
    assert [table.scan(["k"], [v]).collect()[0][0] for v in odd] == odd
    assert table.delete_hashes(["a/b", "x=y"]) == 2 and table.scan(["k"]).count() == 3


def test_expiry(spark, tmp_path):
    now = [100.0]
    table = Engine(spark, str(tmp_path)).add_table("t", hash_by="k", sort_by="k", ttl=10, grace=0, clock=lambda: now[0])
    table.append(spark.createDataFrame([("a",)], "k string"))
    now[0] = 105.0
    table.append(spark.createDataFrame([("b",)], "k string"))
    now[0] = 110.0
    assert values(table.scan(["k"])) == [("b",)] and table.purge() == 1 and table.purge() == 0


def test_filters():
    d = parse_filters(["h == 'it\\'s'", "s >= 5", "s >= 1 && s < 9"], "h", "s")
    assert d.hashes == ["it's"] and d.ranges == [(5, None), (1, 9)]
    for bad in ([], ["h > 'x'"], ["x == 'y'"], ["s <= 4"], ["s >= 1 || s < 3"], ["s >= 1 && x < 3"], ["h == 5"], ["h ="]):
        with pytest.raises(FilterError):
            parse_filters(bad, "h", "s")


def test_time_ranges():
    s = 1514764800
    assert [epoch_seconds(s * 10**p) for p in (0, 3, 6, 9)] == [s] * 4
    assert time_range(("exactly", s), ("exactly", s + 5)) == (s, s + 5)
    assert time_range(("above", s), None) == (s, None) and time_range(("below", s), None) == (0.0, s)
    assert time_range(None, None) is None and time_range(("exactly", s), None) is None


def test_pages(spark):
    assert [len(p) for p in pages(spark.range(10), 4)] == [4, 4, 2]


def test_merge_keeps_later_columns(spark):
    a = spark.createDataFrame([("e", 1)], "col0 string, col1 long")
    b = spark.createDataFrame([("e", 2, "s"), ("f", 3, "s")], "col0 string, col1 long, col3 string")
    assert values(merge([a, b]), "col0", "col1", "col3") == [("e", 1, None), ("e", 2, "s"), ("f", 3, "s")]


def test_compaction(engine, spark, tmp_path):
    table = engine.add_table("t", hash_by="k", sort_by="s")
    for k, n in (("A", 0), ("A", 1), ("C", 1), ("B", 0), ("B", 1), ("B", 2), ("D", 2)):
        table.append(spark.createDataFrame([(k, n)], "k string, s long"))
    out = str(tmp_path / "out")
    assert Compactor(table, FileSink(encoder="parquet", directory=out)).compact() == 7
    done = spark.read.parquet(out)
    assert done.count() == 7 and {"year", "month", "day", "by_k"} <= set(done.columns) and len(done.inputFiles()) == 4
    assert table.scan(["k"]).count() == 0 and Compactor(table, NoopSink()).compact() == 0
    assert table.purge() == 0  # scans under way may still read the files
    table.grace = -1
    assert table.purge() == 7 and table.purge() == 0


def test_compaction_of_a_growing_table(engine, spark, tmp_path):
    """What is appended while a compaction runs is neither dropped nor written twice."""
    table, out = engine.add_table("t", hash_by="k", sort_by="s"), str(tmp_path / "out")

    class Slow(FileSink):
        def write(self, df, partition_by=()):
            if not table.scan(["k"], ["late"]).count():
                table.append(spark.createDataFrame([("late", 9), ("A", 8)], "k string, s long"))
            super().write(df, partition_by)

    table.append(spark.createDataFrame([("A", 1), ("B", 2)], "k string, s long"))
    c = Compactor(table, Slow(encoder="parquet", directory=out))
    assert c.compact() == 1
    assert values(table.scan(["k", "s"])) == [("A", 8), ("late", 9)]
    assert c.compact() == 1 and table.scan(["k"]).count() == 0
    assert values(spark.read.parquet(out), "k", "s") == [("A", 1), ("A", 8), ("B", 2), ("late", 9)]


def test_a_batch_counts_when_it_is_committed(engine, spark, tmp_path):
    """Files without a marker, as of an append that goes on or failed, are seen by no scan and no compaction."""
    table = engine.add_table("t", hash_by="k", sort_by="s")
    done = table.append(spark.createDataFrame([("A", 1)], "k string, s long"))
    half = table.append(spark.createDataFrame([("A", 2)], "k string, s long"))
    marker = next(b.marker for b in table.batches() if b.id == half)
    os.rename(f"{table.path}/_committed/{marker}", tmp_path / "marker")
    assert values(table.scan(["s"])) == [(1,)] and [b.id for b in table.batches()] == [done]
    frame, batches = Compactor(table, NoopSink()).merged()
    assert batches == [done] and frame.count() == 1
    os.rename(tmp_path / "marker", f"{table.path}/_committed/{marker}")
    assert values(table.scan(["s"])) == [(1,), (2,)]


def test_a_named_batch_is_appended_once(engine, spark):
    table = engine.add_table("t", hash_by="k", sort_by="s")
    rows = spark.createDataFrame([("A", 1)], "k string, s long")
    first_id = table.append(rows, batch="b-1")
    assert table.append(rows, batch="b-1") == first_id and table.append(rows, batch="b-10") != first_id
    assert table.scan(["s"]).count() == 2
    table.delete_batches([first_id])
    assert table.append(rows, batch="b-1") == first_id and table.scan(["s"]).count() == 1


def test_streams_get_what_was_stored(engine, spark):
    """Generated values are the same in the stream and in the table."""
    got = []
    sink = PeerSink(ingest=lambda df: got.extend(values(df, "k", "id")))
    sink.stream = sink.write
    table = engine.add_table("t", hash_by="k", sort_by="k", streams=[sink], computed=[Computed("id", Kind.STRING, "make://identifier")])
    table.append(spark.createDataFrame([("A",), ("B",)], "k string"))
    assert got == values(table.scan(["k", "id"])) and len({i for _, i in got}) == 2


def test_deleted_hashes_leave_running_scans_alone(engine, spark):
    table = engine.add_table("t", hash_by="k", sort_by="s", grace=100)
    table.append(spark.createDataFrame([("A", 1), ("B", 2)], "k string, s long"))
    before = table.scan(["s"])
    assert table.delete_hashes(["A", "C"]) == 1
    assert values(before) == [(1,), (2,)] and values(table.scan(["s"])) == [(2,)]
    table.append(spark.createDataFrame([("A", 3)], "k string, s long"))  # later rows of the value are new
    assert table.purge() == 0 and values(table.scan(["s"])) == [(2,), (3,)]
    table.grace = -1
    assert table.purge() == 1 and values(table.scan(["s"])) == [(2,), (3,)]


def test_files_bounded_in_bytes(engine, spark):
    rows = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("s"), F.lit("x" * 1000).alias("x"))
    table = engine.add_table("t", hash_by="k", sort_by="s", file_bytes=100_000)
    table.append(rows.coalesce(1))
    assert 9 <= len(table.frame().inputFiles()) <= 12


def test_pages_by_bytes(engine, spark):
    """Pages go on where the last one ended, and a batch that comes meanwhile moves no row."""
    table = engine.add_table("t", hash_by="k", sort_by="s", rows_per_file=30)
    table.append(spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("s"), F.lit("x" * 100).alias("x")))
    got, token, sizes = [], None, []
    while True:
        page, token = read_page(table, ["s", "x"], ["k == 'a'", "s >= 10 && s < 95"], token, 2500)
        got += [r.s for r in page]
        sizes.append(len(page))
        if token is None:
            break
        if len(sizes) == 2:
            table.append(spark.createDataFrame([("b", 50, "y")], "k string, s long, x string"))
    assert sorted(got) == list(range(10, 95)) and max(sizes) <= 22 and len(sizes) >= 4
    assert read_page(table, ["s"], ["k == 'none'"]) == ([], None)


def test_splits(engine, spark):
    table = engine.add_table("t", hash_by="k", sort_by="s")
    table.append(spark.range(100).select((F.col("id") % 5).cast("string").alias("k"), F.col("id").alias("s")))
    assert sum(r.rows for r in table.splits().collect()) == 100


def test_requests_are_counted(engine):
    engine.add_table("t", hash_by="d", sort_by="b")
    engine.ingest(EVENTS)
    with pytest.raises(FilterError):
        engine.scan("t", ["a"])
    got = {r.request: (r.calls, r.failures) for r in engine.metrics().collect()}
    assert got["ingest"] == (1, 0) and got["scan"] == (1, 1)
    assert engine.log.frame().where("message like 'scan failed%'").count() == 1


def test_a_long_log(spark, tmp_path):
    """No row is lost when the log goes to files, and old files go."""
    log = LogTable(spark, str(tmp_path / "logs"), ttl=1000, flush=100)
    log.append("old", at=time.time() - 5000)
    for i in range(1050):
        log.append(f"row {i}")
    assert log.frame().count() == 1050 and len(log.rows) < 100
    log.rows.clear()
    again = LogTable(spark, str(tmp_path / "logs"), ttl=1000)
    assert again.frame().count() >= 950


def test_settings_of_buckets(spark, tmp_path):
    sinks = [S3Sink(directory=str(tmp_path / b), bucket=b, settings={"accessKey": f"key {b}"}) for b in ("one", "two")]
    for sink in sinks:
        sink.write(spark.range(1))
    hadoop = spark._jsc.hadoopConfiguration()
    assert [hadoop.get(f"fs.s3a.bucket.{b}.access.key") for b in ("one", "two")] == ["key one", "key two"] and hadoop.get("fs.s3a.access.key") in (None, "")


def test_a_failing_message_is_sent_alone(spark, tmp_path):
    path = str(tmp_path / "sent")

    def connect():
        def send(lines):
            if len(lines) > 1 and any('"k":"b"' in x for x in lines):
                raise OSError("refused")
            with open(path, "a") as f:
                f.write("".join(line + "\n" for line in lines))

        return send

    MessageSink(connect=connect, size=2).write(spark.createDataFrame([(k,) for k in "abcd"], "k string").coalesce(1))
    with open(path) as f:
        assert sorted(json.loads(x)["Values"]["k"] for x in f) == ["a", "b", "c", "d"]


def test_a_peer_that_fails(spark):
    """Tried again; left alone after too many failures; asked again after a while."""
    now, calls, broken = [0.0], [], [True]

    def ingest(df):
        calls.append(1)
        if broken[0]:
            raise OSError("down")

    sink = PeerSink(ingest=ingest, tries=2, pause=0, breaks_after=3, rests=10, clock=lambda: now[0])
    for _ in range(3):
        with pytest.raises(OSError, match="down"):
            sink.write(spark.range(1))
    with pytest.raises(ConnectionError):
        sink.write(spark.range(1))
    assert len(calls) == 6
    now[0], broken[0] = 11.0, False
    sink.write(spark.range(1))
    assert len(calls) == 7 and sink._failures == 0


def test_many_values_are_warned_of(engine, spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.table.MANY_FOLDERS", 5)
    engine.add_table("t", hash_by="k", sort_by="k").append(spark.range(9).select(F.col("id").cast("string").alias("k")))
    assert engine.log.frame().where("level = 'warning' and message like '%buckets%'").count() == 1


def test_time_limit_and_reload(spark, tmp_path, monkeypatch):
    with pytest.raises(TimeoutError):
        limited(lambda: time.sleep(5), 0.05)
    assert limited(lambda: 3, 1) == 3
    monkeypatch.syspath_prepend(str(tmp_path))
    module = tmp_path / "made_for_a_test.py"
    module.write_text("def f(rows):\n    return 1\n")
    assert load("python:made_for_a_test:f")(None) == 1
    module.write_text("def f(rows):\n    return 22\n")
    os.utime(module, ns=(time.time_ns() + 10**9,) * 2)
    assert load("python:made_for_a_test:f")(None) == 22


def test_failed_compaction_keeps_rows(engine, spark):
    class Failing(Sink):
        def write(self, df, partition_by=()):
            raise OSError("full")

    table = engine.add_table("t", hash_by="k", sort_by="k")
    table.append(spark.createDataFrame([("A",)], "k string"))
    with pytest.raises(OSError, match="full"):
        Compactor(table, MultiSink(sinks=[Failing(), NoopSink()])).compact()
    assert table.scan(["k"]).count() == 1
    with pytest.raises(ValueError, match="without a sink"):
        Compactor(table, MultiSink())


def test_scheduled_compaction(engine, spark, tmp_path):
    table = engine.add_table("t", hash_by="k", sort_by="k")
    table.append(spark.createDataFrame([("A",)], "k string"))
    c = Compactor(table, FileSink(directory=str(tmp_path / "out")), interval=0.1)
    c.start()
    for _ in range(100):
        if not table.scan(["k"]).count():
            break
        time.sleep(0.2)
    c.close()
    assert spark.read.orc(str(tmp_path / "out")).count() == 1


def test_sinks(spark, tmp_path, engine):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, n int")
    path = str(tmp_path / "sent")

    def connect():
        def send(lines):
            with open(path, "a") as f:
                f.write("".join(line + "\n" for line in lines))

        return send

    MessageSink(filter="n > 1", connect=connect).stream(df)
    with open(path) as f:
        assert json.loads(f.read()) == {"Values": {"k": "b", "n": 2}, "Schema": {"k": "VARCHAR", "n": "INTEGER"}}
    AccountsSink(container="c", accounts=["x", "y"], weights=[0, 1], encoder="json", pattern=str(tmp_path) + "/{account}/{container}").write(df)
    assert spark.read.text(str(tmp_path / "y/c")).count() == 3
    ConsoleSink().write(df)
    assert engine.log.frame().where("message like '%Values%'").count() == 3
    with pytest.raises(ValueError, match="no streamed rows"):
        FileSink().stream(df)
    with pytest.raises(ValueError, match="unknown encoder"):
        encoder("avro")
    with pytest.raises(ValueError, match="no known sink"):
        make_sink({"nothing": {}})
    assert make_sink({"gcs": {"bucket": "b", "prefix": "p/"}}).directory == "gs://b/p"
    assert len(make_sink({"console": {}, "file": {"dir": "x"}}).sinks) == 2


def test_streams_do_not_stop_ingestion(engine, spark):
    got = []
    good = PeerSink(ingest=lambda df: got.append(df.count()))
    good.stream = good.write
    table = engine.add_table("t", hash_by="k", sort_by="k", streams=[PeerSink(), good])
    table.append(spark.createDataFrame([("A",)], "k string"))
    assert got == [1] and table.scan(["k"]).count() == 1
    assert engine.log.frame().where("level = 'error'").count() == 1


def test_metadata(engine):
    engine.add_table("t", hash_by="d", sort_by="b")
    engine.ingest(EVENTS)
    assert values(engine.describe_table("t"), "column", "type", "hash_by") == [("a", "VARCHAR", "d"), ("b", "BIGINT", "d"), ("d", "VARCHAR", "d"), ("e", "JSON", "d")]
    assert [r.table for r in engine.list_tables().collect()] == ["logs", "nodes", "t"]
    assert engine.describe().where("table = 'nodes'").count() == 6
    assert engine.nodes().count() == 1 and engine.sql("select address from nodes").count() == 1
    assert duration(90061) == "1 day 1 hour 1 minute 1 second" and duration(0) == "0 seconds"
    assert len(hardware_address()) == 17


def test_stats(spark):
    stats = Stats("s")
    stats.watch(spark.range(5), n=F.count("*"), top=F.max("id")).collect()
    assert stats.get() == {"n": 5, "top": 4}


def test_order_and_file_sizes(engine, spark):
    table = engine.add_table("t", hash_by="k", sort_by="s", rows_per_file=4)
    table.append(spark.range(20).select((F.col("id") % 2).cast("string").alias("k"), (20 - F.col("id")).alias("s")))
    assert [tuple(r) for r in table.in_order(["k", "s"]).collect()] == sorted(((str(i % 2), 20 - i) for i in range(20)))
    assert len(table.frame().inputFiles()) == 6


def test_row_hash(spark):
    a = spark.createDataFrame([(1, "x"), (1, None)], "a long, b string")
    hashes = [r[0] for r in a.select(row_hash(a)).collect()]
    b = a.select("b", "a")
    assert hashes == [r[0] for r in b.select(row_hash(b)).collect()] and len(set(hashes)) == 2


def test_config_store():
    texts = {"s3://c": "env: remote"}
    store = Store("TM", texts.get, {"TM_URI": "s3://c", "TM_ENV": "local", "TM_DOMAIN": "d"})
    assert (store.value.env, store.value.domain) == ("remote", "d")
    changed = []
    stop = store.watch(0.05, changed.append)
    texts["s3://c"] = "env: later"
    for _ in range(100):
        if changed and changed[-1].env == "later":
            break
        time.sleep(0.05)
    stop()
    assert store.value.env == "later"


def test_config(spark, tmp_path):
    text = f"""
storage: {{dir: {tmp_path}}}
readers: {{presto: {{schema: s}}}}
computed: [{{name: up, type: string, func: upper(k)}}]
tables:
  events:
    hashBy: k
    sortBy: t
    schema: {{k: string, t: int64, up: string}}
    compact: {{interval: 60, encoder: parquet, file: {{dir: {tmp_path}/out}}}}
    streams: [{{noop: {{}}}}]
  other: {{}}
"""
    config = from_env("TM", {"TM": text})
    assert config.tables["other"].ttl == 3600 and config.tables["other"].hash_by == "event" and config.tables["other"].sort_by == "tsi"
    assert from_env("TM", {"TM_STORAGE_DIR": "/x"}).storage_dir == "/x" and parse("").env == ""
    engine = Engine.from_config(spark, config)
    engine.ingest([{"k": "a", "t": 1}], ["events"])
    assert values(engine.scan("events", ["k", "up"], ["k == 'a'"])) == [("a", "A")]
    assert engine.compact() == {"events": 1} and spark.read.parquet(f"{tmp_path}/out").count() == 1
    engine.close()
