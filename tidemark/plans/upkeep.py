"""Queries of the engine's own operators that the others leave out: keys, splits, pages, drops, triggers, sinks, settings, system tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.config import parse
from tidemark.functions import values
from tidemark.functions.scripting import Computed
from tidemark.functions.types import Kind
from tidemark.operators.compact import Compactor
from tidemark.operators.engine import Engine
from tidemark.operators.scan import FilterError, read_page, time_range
from tidemark.operators.sinks import ConsoleSink, FileSink, make_sinks
from tidemark.operators.transform import chain, normalise
from tidemark.plans.catalogue import LONG, hot, ntz, query, source, work_folder
from tidemark.sources.readers import first
from tidemark.streaming.ingest import compact_on, file_stream, ingest_notified

# ---------------------------------------------------------------- keys and layout


@query("select event_id, value from events where event_type = 'click'")
def hash_column_in_other_case(spark, sf_dir):
    """A file's column is found whatever its letter case."""
    engine = Engine(spark, work_folder(spark))
    engine.add_table("t", hash_by="EVENT_TYPE", sort_by="ts", ttl=LONG)
    engine.ingest({"parquet": f"{sf_dir}/events.parquet"})
    return engine.scan("t", ["event_id", "value"], ["EVENT_TYPE == 'click'"])


@query("select l_orderkey, l_linenumber from lineitem where l_quantity in (17, 18)")
def hash_by_float(spark, sf_dir):
    engine = Engine(spark, work_folder(spark))
    engine.add_table("t", hash_by="l_quantity", sort_by="l_orderkey", ttl=LONG)
    engine.ingest({"parquet": f"{sf_dir}/lineitem.parquet"})
    return engine.scan("t", ["l_orderkey", "l_linenumber"], ["l_quantity == '17.0'", "l_quantity == '18.0'"])


@query("select event_id from events where event_type in ('view', 'error')")
def hash_by_bytes(spark, sf_dir):
    """Bytes come in as text, and are hash values as such."""
    folder = work_folder(spark)
    source(spark, sf_dir, "events").select("event_id", F.encode("event_type", "utf-8").alias("kind")).write.parquet(folder)
    engine = Engine(spark, work_folder(spark))
    engine.add_table("t", hash_by="kind", sort_by="event_id", ttl=LONG)
    engine.ingest({"parquet": folder})
    return engine.scan("t", ["event_id"], ["kind == 'view'", "kind == 'error'"])


@query("select event_type, count(*) as n, timestamp '2033-05-18 03:33:20' as at from events group by event_type")
def ingestion_time(spark, sf_dir):
    """Every stored row keeps when it was taken in."""
    table = hot(spark, sf_dir, clock=lambda: 2_000_000_000.0).tables["eventlog"]
    rows = table._read(table.batches())[0][1]
    return rows.groupBy("event_type", F.col("_ingested_at").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n, true as several from events group by event_type")
def files_in_bytes(spark, sf_dir):
    """Files of a bounded number of bytes: each value has several, which hold its rows."""
    table = hot(spark, sf_dir, file_bytes=2000).tables["eventlog"]
    rows = table.scan(["event_type"], place=True)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), (F.count_distinct("_file") > 1).alias("several"))


# ---------------------------------------------------------------- reading


@query("select count(*) as n, true as several from events")
def split_planning(spark, sf_dir):
    """The splits of a scan hold all rows, each once."""
    splits = hot(spark, sf_dir).tables["eventlog"].splits()
    return splits.agg(F.sum("rows").alias("n"), (F.count("*") >= 1).alias("several"))


@query("select event_id, value from events where event_type = 'signup' and ts >= timestamp '2024-01-10'")
def paged_scan(spark, sf_dir):
    """A scan page by page, each gone on from the last one's token."""
    table = hot(spark, sf_dir).tables["eventlog"]
    rows, token = [], None
    while True:
        page, token = read_page(table, ["event_id", "value"], ["event_type == 'signup'", "ts >= 1704844800"], token, 20_000)
        rows += [tuple(r) for r in page]
        if token is None:
            return spark.createDataFrame(rows, "event_id long, value double")


@query("select event_type, ts from events where event_type = (select min(event_type) from events) order by ts limit 1")
def first_row(spark, sf_dir):
    """The first row in the order of keys."""
    row = first(hot(spark, sf_dir).tables["eventlog"].in_order(["event_type", "ts"]), ["event_type", "ts"])
    return spark.createDataFrame([tuple(row)], "event_type string, ts timestamp").withColumn("ts", ntz("ts"))


@query("select * from (values ('eventlog', 'your query must contain ''event_type'' constraint'), ('range', '''event_type > \"a\"'' is neither event_type == ''value'' nor a range ts >= a [&& ts < b]')) as x(asked, answer)")
def refused_scans(spark, sf_dir):
    """A scan without a hash value, and one by a range of hash values."""
    engine, out = hot(spark, sf_dir), []
    for name, filters in (("eventlog", ["ts >= 1704844800"]), ("range", ['event_type > "a"'])):
        try:
            engine.scan("eventlog", ["event_id"], filters)
        except FilterError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "asked string, answer string")


@query("select id, low::double as low, high::double as high from (values (1, 1514764800, 1514764860), (2, 1514764800, null), (3, 0, 1514764800), (4, null, null)) as x(id, low, high)")
def bounds_to_ranges(spark, sf_dir):
    """Pairs of bounds, in any unit, as ranges of seconds."""
    s = 1_514_764_800
    asked = [(("exactly", s * 1000), ("exactly", (s + 60) * 10**6)), (("above", s), None), (("below", s * 10**9), None), (("exactly", s), None)]
    rows = [(i, *(time_range(low, high) or (None, None))) for i, (low, high) in enumerate(asked, 1)]
    return spark.createDataFrame([(i, None if a is None else float(a), None if b is None else float(b)) for i, a, b in rows], "id int, low double, high double")


# ---------------------------------------------------------------- functions


@query("select event_id, upper(event_type) as event_type, value * 2 as value from events where value > 50")
def function_chain(spark, sf_dir):
    """Functions of frames, one after the other."""
    events = source(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return chain(events, [lambda df: df.where("value > 50"), lambda df: df.withColumn("value", F.col("value") * 2), lambda df: df.withColumn("event_type", F.upper("event_type"))])


@query("select event_id, date_trunc('second', ts)::timestamp as at from events")
def seconds_to_times(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return source(spark, sf_dir, "events").select("event_id", values.seconds_to_timestamp(seconds).cast("timestamp_ntz").alias("at"))


@query("select * from (values (1, timestamp '2018-01-01 00:00:00'), (2, timestamp '2018-01-01 05:30:00.25'), (3, null), (4, null)) as x(id, \"at\")")
def times_with_offsets(spark, sf_dir):
    texts = [(1, "2018-01-01T08:00:00+08:00"), (2, "2018-01-01T00:00:00.25-05:30"), (3, "2018-01-01T00:00:00"), (4, "2018-01-01T00:00:00+8")]
    return spark.createDataFrame(texts, "id int, v string").select("id", values.parse_timestamp(F.col("v")).cast("timestamp_ntz").alias("at"))


@query("select event_id, event_type as kind from events")
def bytes_to_text(spark, sf_dir):
    return normalise(source(spark, sf_dir, "events").select("event_id", F.encode("event_type", "utf-8").alias("kind")))


@query("select count(distinct (user_id, event_type)) as different, true as stable from events")
def row_hashes(spark, sf_dir):
    """Equal rows have equal hashes, whatever the order of columns; other rows have others."""
    rows = source(spark, sf_dir, "events").select("user_id", "event_type")
    turned = rows.select("event_type", "user_id")
    hashes = rows.select(values.row_hash(rows).alias("h")).distinct()
    again = turned.select(values.row_hash(turned).alias("h")).distinct()
    return hashes.agg(F.count("*").alias("different")).crossJoin(again.join(hashes, "h", "left_anti").agg((F.count("*") == 0).alias("stable")))


# ---------------------------------------------------------------- compaction, drops and triggers


@query("select event_id, event_type from events")
def compaction_concurrent(spark, sf_dir):
    """Rows that come while a compaction runs stay in the hot table; no row is lost or written twice."""
    engine, folder = Engine(spark, work_folder(spark)), work_folder(spark)
    table = engine.add_table("eventlog", hash_by="event_type", sort_by="ts", ttl=LONG)
    events = source(spark, sf_dir, "events").transform(normalise)
    table.append(events.where("event_type = 'view'"))

    class Slow(FileSink):
        def write(self, df, partition_by=()):
            table.append(events.where("event_type != 'view'"))
            super().write(df, partition_by)

    Compactor(table, Slow(directory=folder)).compact()
    return spark.read.orc(folder).select("event_id", "event_type").union(table.scan(["event_id", "event_type"]))


@query("select event_id, value from events")
def compaction_on_trigger(spark, sf_dir):
    """A stream's micro-batch starts a compaction."""
    engine, folder = hot(spark, sf_dir), work_folder(spark)
    spark.range(1).write.parquet(f"{folder}/in")
    stream = file_stream(spark, f"{folder}/in", spark.range(1).schema, "parquet")
    compact_on(stream, Compactor(engine.tables["eventlog"], FileSink(directory=f"{folder}/out")), f"{folder}/state", None).awaitTermination()
    return spark.read.orc(f"{folder}/out").select("event_id", "value").union(engine.tables["eventlog"].scan(["event_id", "value"]))


@query("select event_id, user_id from events where event_type in ('click', 'view')")
def queue_ingest(spark, sf_dir):
    """Objects named by a queue's notifications."""
    folder = work_folder(spark)
    events = source(spark, sf_dir, "events")
    for kind in ("click", "view", "error"):
        events.where(F.col("event_type") == kind).coalesce(1).write.parquet(f"{folder}/store/{kind}.parquet")
    record = lambda kind, what: {"eventName": what, "s3": {"bucket": {"name": "store"}, "object": {"key": f"{kind}.parquet"}}}
    bodies = [{"Records": [record("click", "ObjectCreated:Put"), record("error", "ObjectRemoved:Delete")]}, {"Records": [record("view", "ObjectCreated:Put"), record("click", "ObjectCreated:Put")]}]
    spark.createDataFrame([(json.dumps(b),) for b in bodies], "value string").coalesce(1).write.parquet(f"{folder}/queue")
    engine = Engine(spark, f"{folder}/hot")
    engine.add_table("eventlog", hash_by="event_type", sort_by="ts", ttl=LONG)
    stream = file_stream(spark, f"{folder}/queue", spark.createDataFrame([], "value string").schema, "parquet")
    ingest_notified(engine, stream, f"{folder}/state", pattern=f"{folder}/{{bucket}}/{{key}}").awaitTermination()
    return engine.tables["eventlog"].scan(["event_id", "user_id"])


@query("select event_id, event_type from events where event_type = 'click'")
def named_tables(spark, sf_dir):
    """Only the tables that are named get rows; unknown names are passed over."""
    engine = Engine(spark, work_folder(spark))
    for name in ("a", "b"):
        engine.add_table(name, hash_by="event_type", sort_by="ts", ttl=LONG)
    clicks = source(spark, sf_dir, "events").where("event_type = 'click'").transform(normalise)
    engine.ingest(clicks, ["b", "no such table"])
    return engine.tables["b"].scan(["event_id", "event_type"]).union(engine.tables["a"].frame().select(F.lit(0).cast("long"), F.lit("in a")))


# ---------------------------------------------------------------- sinks, settings, system tables


@query("select event_id, value from events where value > 200")
def configured_sinks(spark, sf_dir):
    """Sinks from settings: a file sink with a filter and an encoder, and one that keeps nothing."""
    folder = work_folder(spark)
    make_sinks([{"file": {"dir": folder, "encoder": "parquet", "filter": "value > 200"}}, {"noop": {}}]).write(source(spark, sf_dir, "events"))
    return spark.read.parquet(folder).select("event_id", "value")


@query("select event_id from events where value > 200")
def console_sink(spark, sf_dir):
    """All rows as JSON in the log."""
    engine = Engine(spark, work_folder(spark))
    ConsoleSink(filter="value > 200").write(source(spark, sf_dir, "events").select("event_id", "value"))
    logged = engine.log.frame().where("message like '%Values%'")
    return logged.select(F.get_json_object("message", "$.Values.event_id").cast("long").alias("event_id"))


@query("select event_id, upper(event_type) as shout from events where event_type = 'error'")
def configured_engine(spark, sf_dir):
    """An engine from YAML settings: table, schema and a computed column."""
    text = f"{{storage: {{dir: '{work_folder(spark)}'}}, computed: [{{name: shout, type: string, func: upper(event_type)}}], tables: {{eventlog: {{hashBy: event_type, sortBy: ts, ttl: {LONG}}}}}}}"
    engine = Engine.from_config(spark, parse(text))
    engine.ingest({"parquet": f"{sf_dir}/events.parquet"})
    return engine.scan("eventlog", ["event_id", "shout"], ["event_type == 'error'"])


@query("select * from (values ('address', 'VARCHAR'), ('peers', 'VARCHAR'), ('private', 'VARCHAR'), ('public', 'VARCHAR'), ('started', 'BIGINT'), ('uptime', 'VARCHAR')) as x(\"column\", type) where (select 1) = 1")
def nodes_schema(spark, sf_dir):
    """The nodes table's columns, from the table itself."""
    nodes = Engine(spark, work_folder(spark)).nodes()
    return spark.createDataFrame([(f.name, {"string": "VARCHAR", "bigint": "BIGINT"}[f.dataType.simpleString()]) for f in nodes.schema], "column string, type string")


@query("select 1::bigint as n, true as started, true as peers, true as same")
def nodes_row(spark, sf_dir):
    """One row for the driver, which began in the past and knows the executors."""
    engine = Engine(spark, work_folder(spark))
    return engine.sql("select count(*) as n, bool_and(started > 1500000000 and started <= unix_timestamp()) as started, bool_and(size(from_json(peers, 'array<string>')) >= 1) as peers, bool_and(from_json(private, 'array<string>')[0] = address) as same from nodes")


@query("select * from (values ('info', 'ready'), ('warning', 'disk is full'), ('error', 'lost')) as x(level, message)")
def log_rows(spark, sf_dir):
    """Live log rows, out of memory and files; an expired one is gone."""
    engine = Engine(spark, work_folder(spark))
    engine.log.append("long ago", at=1_000_000.0)
    engine.log.append("ready")
    engine.log.store()
    engine.log.append("disk is full", "warning")
    engine.log.append("lost", "error")
    return engine.sql("select level, message from logs where message in ('long ago', 'ready', 'disk is full', 'lost')")


@query("select * from (values ('logs', 'address', 'VARCHAR', '', 'time'), ('logs', 'level', 'VARCHAR', '', 'time'), ('logs', 'message', 'VARCHAR', '', 'time'), ('logs', 'time', 'TIMESTAMP', '', 'time'), ('nodes', 'address', 'VARCHAR', '', 'address'), ('nodes', 'started', 'BIGINT', '', 'address')) as x(\"table\", \"column\", type, hash_by, sort_by)")
def describe_system_tables(spark, sf_dir):
    return hot(spark, sf_dir).describe().where("table = 'logs' or (table = 'nodes' and column in ('address', 'started'))")


@query("select * from (values ('ingest', 1, 0), ('scan', 2, 1)) as x(request, calls, failures)")
def request_metrics(spark, sf_dir):
    """What was asked of the engine, and what failed."""
    engine = hot(spark, sf_dir)
    engine.scan("eventlog", ["event_id"], ["event_type == 'view'"])
    try:
        engine.scan("eventlog", ["event_id"], [])
    except FilterError:
        pass
    return engine.metrics().select("request", F.col("calls").cast("int").alias("calls"), F.col("failures").cast("int").alias("failures"))


@query("select event_id, true as same from events where event_type = 'error'")
def streamed_identifiers(spark, sf_dir):
    """A stream gets the identifiers that are stored."""
    from tidemark.operators.sinks import PeerSink

    got = []
    sink = PeerSink(ingest=got.append)
    sink.stream = sink.write
    engine = Engine(spark, work_folder(spark))
    table = engine.add_table("t", hash_by="event_type", sort_by="event_id", ttl=LONG, streams=[sink], computed=[Computed("id", Kind.STRING, "make://identifier")])
    engine.ingest(source(spark, sf_dir, "events").where("event_type = 'error'").transform(normalise))
    return got[0].select("event_id", "id").join(table.scan(["event_id", "id"]).withColumnRenamed("id", "stored"), "event_id").select("event_id", (F.col("id") == F.col("stored")).alias("same"))
