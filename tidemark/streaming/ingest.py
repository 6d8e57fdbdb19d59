"""Continuous ingestion with Structured Streaming: files as they arrive, and messages by subject."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scripting import log
from tidemark.functions.types import MARK, Kind
from tidemark.operators.compact import Compactor
from tidemark.operators.engine import Engine
from tidemark.operators.transform import normalise
from tidemark.sources.readers import FORMATS

#: Files and messages of a micro-batch at most, which is the back-pressure.
FILES_PER_BATCH, MESSAGES_PER_BATCH = 1000, 1_000_000
#: Where an object named by a notification is read.
OBJECT = "s3a://{bucket}/{key}"


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, form: str = "orc", files_per_batch: int = FILES_PER_BATCH, **options: str) -> DataFrame:
    """Files that appear in a folder."""
    return spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_batch, **options).format(form).load(directory)


def kafka_messages(spark: SparkSession, servers: str, topics: str, messages_per_batch: int = MESSAGES_PER_BATCH, **options: str) -> DataFrame:
    """Messages (subject, value) of topics, for ingest_messages(); needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topics, "maxOffsetsPerTrigger": str(messages_per_batch), **options}).load()
    return raw.select(F.col("topic").alias("subject"), F.col("value").cast("string").alias("value"))


def batch_name(checkpoint: str, batch: int, part: int = 0) -> str:
    """The name of what a micro-batch brings into a table."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{batch}-{part}"


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None) -> StreamingQuery:
    """Run for good every interval, or over all that is there now."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def ingest_stream(engine: Engine, stream: DataFrame, checkpoint: str, tables: Iterable[str] | None = None, source: str = "parquet", interval: str | None = None) -> StreamingQuery:
    """Append every micro-batch to the tables. A batch that fails is tried again when the query starts anew.

    Batches are named after the checkpoint and their number, so a micro-batch that comes again adds nothing."""
    names = None if tables is None else list(tables)

    def each(df: DataFrame, batch: int) -> None:
        out = engine.ingest(normalise(df, source), names, batch_name(checkpoint, batch))
        log("info", f"stream batch {batch}: {out}")

    return _start(stream, each, checkpoint, interval)


def parse_messages(messages: DataFrame, body: str = "value") -> DataFrame:
    """Messages with a JSON array of flat events -> a map column, event, of names to JSON-encoded values, a row for each event."""
    events = F.from_json(F.col(body).cast("string"), "array<map<string,string>>")
    return messages.withColumn("event", F.explode(events)).drop(body)


def event_columns(df: DataFrame, columns: Mapping[str, Kind]) -> DataFrame:
    """The event's values as columns of the given types; null where they don't parse."""
    from tidemark.functions.values import parse_text

    return df.select(*(parse_text(F.col("event")[name], kind).alias(name, metadata={MARK: Kind.JSON.name} if kind is Kind.JSON else {}) for name, kind in columns.items()))


def matches(subject: F.Column, pattern: str) -> F.Column:
    """Whether a subject fits a pattern of dot-separated words; * stands for one word, > for the rest."""
    parts = {"*": "[^.]+", ">": ".+"}
    escaped = [parts.get(w, "".join(c if c.isalnum() or c in "_-" else f"[{c}]" for c in w)) for w in pattern.split(".")]
    return subject.rlike("^" + "[.]".join(escaped) + "$")


def ingest_messages(engine: Engine, stream: DataFrame, routes: Mapping[str, str], checkpoint: str, subject: str = "subject", body: str = "value", interval: str | None = None) -> StreamingQuery:
    """Messages (subject, body) -> the tables that the routes (subject pattern: table) name. The body is a JSON array of events.

    Columns are those of a table's static schema; without one, the names found in the micro-batch, as numbers or texts."""

    def each(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            for k, (pattern, name) in enumerate(routes.items()):
                own = parse_messages(df.where(matches(F.col(subject), pattern)), body)
                schema = engine.tables[name].static_schema()
                if schema is None:
                    schema = _found(own)
                if schema:
                    engine.ingest(event_columns(own, schema), [name], batch_name(checkpoint, batch, k))
        finally:
            df.unpersist()

    return _start(stream, each, checkpoint, interval)


def notified_objects(messages: DataFrame, body: str = "value", pattern: str = OBJECT) -> DataFrame:
    """Messages of an object store's queue (JSON with Records) -> path: of the objects that were created, each once."""
    record = "struct<eventName:string,s3:struct<bucket:struct<name:string>,object:struct<key:string>>>"
    records = messages.select(F.explode(F.from_json(F.col(body).cast("string"), f"Records array<{record}>")["Records"]).alias("r")).where(F.col("r.eventName").contains("ObjectCreated"))
    head, middle, tail = re.split(r"\{bucket\}|\{key\}", pattern)
    return records.select(F.concat(F.lit(head), F.col("r.s3.bucket.name"), F.lit(middle), F.url_decode("r.s3.object.key"), F.lit(tail)).alias("path")).where("path is not null").distinct()


def ingest_notified(engine: Engine, stream: DataFrame, checkpoint: str, tables: Iterable[str] | None = None, body: str = "value", pattern: str = OBJECT, interval: str | None = None) -> StreamingQuery:
    """Read the objects that a queue's messages name, by their extension, and append them to the tables.

    The queue is any stream of messages, such as a queue connector's or kafka_messages(), which bounds the messages of a micro-batch and so
    the paths that come to the driver. Objects of other extensions are logged and passed over."""
    names = None if tables is None else list(tables)

    def each(df: DataFrame, batch: int) -> None:
        by_extension: dict[str, list[str]] = {}
        for (path,) in notified_objects(df, body, pattern).orderBy("path").collect():
            by_extension.setdefault(path.rpartition(".")[2].lower(), []).append(path)
        for k, (extension, paths) in enumerate(sorted(by_extension.items())):
            if extension in FORMATS:
                engine.ingest({extension: paths}, names, batch_name(checkpoint, batch, k))
            else:
                log("warning", f"notified of {len(paths)} objects with the unsupported extension {extension!r}")

    return _start(stream, each, checkpoint, interval)


def _found(events: DataFrame) -> dict[str, Kind]:
    """Names in the events, each with float64 if all its values are numbers, bool if all are truth values, else text."""
    pairs = events.select(F.explode("event").alias("name", "value")).where("value is not null")
    kinds = pairs.groupBy("name").agg(F.every(F.col("value").rlike(r"^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$")).alias("number"), F.every(F.col("value").isin("true", "false")).alias("truth"), F.every(F.col("value").rlike(r"(?s)^[\[{].*[\]}]$")).alias("nested"))
    return {r["name"]: Kind.FLOAT64 if r["number"] else Kind.BOOL if r["truth"] else Kind.JSON if r["nested"] else Kind.STRING for r in kinds.collect()}


def counted_by_window(stream: DataFrame, time: str, keys: Iterable[str], window: str, late: str) -> DataFrame:
    """Rows of a stream by window of event time and keys; rows later than the watermark are left out, and a window is given once it is over."""
    at = F.window(F.col(time), window)
    return stream.withWatermark(time, late).groupBy(at, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: float) -> DataFrame:
    """key, start, end, n: a row for each session of a key that is over, which is when the key's next row comes later than gap seconds.

    Each key's open session is the state; rows of a micro-batch are taken in order of time, and rows before an open session belong to it."""

    def step(own: tuple, batches, state):
        times = sorted(t for b in batches for t in b["at"].tolist())
        start, end, n = state.get if state.exists else (None, None, 0)
        out = []
        for t in times:
            if n and t - end > gap:
                out.append((own[0], start, end, n))
                start, end, n = t, t, 0
            start, end, n = (t, t, 1) if not n else (min(start, t), max(end, t), n + 1)
        if n:
            state.update((start, end, n))
        if out:
            yield pd.DataFrame(out, columns=[key, "start", "end", "n"])

    kind = stream.schema[key].dataType.simpleString()
    found = stream.select(key, F.col(time).cast("timestamp").cast("double").alias("at")).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, start double, end double, n long", "start double, end double, n long", "append", "NoTimeout")
    return found.select(key, *(F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long")).alias(c) for c in ("start", "end")), "n")


def compact_on(stream: DataFrame, compactor: Compactor, checkpoint: str, interval: str | None = "30 seconds") -> StreamingQuery:
    """A compaction after every micro-batch of a stream, at most one for each interval; without an interval, over what is there now."""
    return _start(stream, lambda df, batch: compactor.compact(), checkpoint, interval)
