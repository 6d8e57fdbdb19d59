"""Sinks: where compacted blocks and streamed rows go. Every sink applies its filter."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tidemark.functions.scripting import keep, log
from tidemark.functions.values import row_json

#: Encoders of blocks: Spark's writer, and its options. `json` writes rows with their types.
ENCODERS: dict[str, tuple[str, dict[str, str]]] = {"orc": ("orc", {"compression": "zlib"}), "parquet": ("parquet", {"compression": "snappy"}), "block": ("parquet", {"compression": "snappy"}), "json": ("text", {})}
DEFAULT_ENCODER = "orc"


def encoder(name: str | None) -> tuple[str, dict[str, str]]:
    name = (name or DEFAULT_ENCODER).lower()
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; there are {sorted(ENCODERS)}")
    return ENCODERS[name]


def write_encoded(df: DataFrame, path: str, name: str | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Rows under a folder in an encoder's format, with folders for the partition columns."""
    form, options = encoder(name)
    if form == "text":
        df = df.select(*partition_by, row_json(df.drop(*partition_by)).alias("value"))
    df.write.mode("append").options(**options).partitionBy(*partition_by).format(form).save(path)


@dataclass
class Sink:
    """write() takes a merged block and its name; stream() takes rows as they come in."""

    filter: str | None = None
    encoder: str | None = None

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        raise NotImplementedError

    def stream(self, df: DataFrame) -> None:
        raise ValueError(f"{type(self).__name__} takes no streamed rows")

    def kept(self, df: DataFrame) -> DataFrame:
        return keep(df, self.filter)


@dataclass
class FileSink(Sink):
    """Any folder that Spark writes to: local, s3a://, gs://, abfss://."""

    directory: str = "."

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        write_encoded(self.kept(df), self.directory, self.encoder, partition_by)


def object_store(scheme: str, bucket: str, prefix: str = "", **options: Any) -> FileSink:
    """A sink to an object store; credentials and endpoints are settings of Spark's connector."""
    return FileSink(directory="/".join(x.strip("/") if i else x for i, x in enumerate((f"{scheme}://{bucket}", prefix)) if x), **options)


#: The connector's settings for options that a sink to s3 may carry.
S3_SETTINGS = {"endpoint": "endpoint", "region": "endpoint.region", "sse": "encryption.algorithm", "accessKey": "access.key", "secretKey": "secret.key", "concurrency": "threads.max"}


@dataclass
class S3Sink(FileSink):
    """Its settings hold for its bucket alone, so sinks to several buckets don't disturb each other."""

    bucket: str = ""
    settings: Mapping[str, Any] = field(default_factory=dict)

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        hadoop = df.sparkSession._jsc.hadoopConfiguration()
        for key, value in self.settings.items():
            hadoop.set(f"fs.s3a.bucket.{self.bucket}.{S3_SETTINGS[key]}", str(value))
        super().write(df, partition_by)


@dataclass
class AccountsSink(Sink):
    """One of several storage accounts for each write, at random, by weight where weights are given."""

    container: str = ""
    accounts: list[str] = field(default_factory=list)
    weights: list[int] | None = None
    prefix: str = ""
    pattern: str = "abfss://{container}@{account}.dfs.core.windows.net/{prefix}"
    choose: Callable[..., list[str]] = random.choices

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        if self.weights is not None and len(self.weights) != len(self.accounts):
            raise ValueError("there must be as many weights as storage accounts")
        account = self.choose(self.accounts, weights=self.weights)[0]
        write_encoded(self.kept(df), self.pattern.format(container=self.container, account=account, prefix=self.prefix), self.encoder, partition_by)


@dataclass
class ConsoleSink(Sink):
    """Rows as JSON in the log, a partition in memory at a time; only the first ones, if rows says how many."""

    rows: int | None = None

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        lines = self.kept(df).select(row_json(df))
        for (line,) in (lines if self.rows is None else lines.limit(self.rows)).toLocalIterator():
            log("info", line)

    def stream(self, df: DataFrame) -> None:
        """Nothing, as the console is for blocks."""


class NoopSink(Sink):
    """All work is done, nothing is kept."""

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        self.kept(df).write.format("noop").mode("overwrite").save()

    stream = write


@dataclass
class PeerSink(Sink):
    """Another engine in this process or behind a function that takes a frame.

    A write is tried several times with growing pauses; after so many writes in a row that failed, writes fail at once for a while."""

    ingest: Callable[[DataFrame], Any] | None = None
    tries: int = 3
    pause: float = 0.1
    breaks_after: int = 5
    rests: float = 30.0
    clock: Callable[[], float] = time.monotonic
    _failures: int = field(default=0, repr=False)
    _rests_until: float = field(default=0.0, repr=False)

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        if self._failures >= self.breaks_after and self.clock() < self._rests_until:
            raise ConnectionError("the peer failed too often and is left alone for a while")
        for left in reversed(range(self.tries)):
            try:
                self.ingest(self.kept(df))
                self._failures = 0
                return
            except Exception:
                if not left:
                    self._failures += 1
                    self._rests_until = self.clock() + self.rests
                    raise
                time.sleep(self.pause * 2 ** (self.tries - 1 - left))


def _persistently(publish: Callable[[list[str]], None], line: str, tries: int) -> None:
    for left in reversed(range(tries)):
        try:
            return publish([line])
        except Exception:
            if not left:
                raise


@dataclass
class MessageSink(Sink):
    """A message for each row, in JSON, sent from the executors by publish(rows): a client of a topic.

    connect: makes that function in a task; it gets batches of at most size messages. A batch that fails is sent anew message by message, each
    up to tries times, so what had come through with it is sent twice at most."""

    connect: Callable[[], Callable[[list[str]], None]] | None = None
    size: int = 1000
    tries: int = 3

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        connect, size, tries = self.connect, self.size, self.tries

        def send(batches):
            publish = connect()
            for pdf in batches:
                lines = pdf["value"].tolist()
                for start in range(0, len(lines), size):
                    part = lines[start : start + size]
                    try:
                        publish(part)
                    except Exception:
                        for line in part:
                            _persistently(publish, line, tries)
                yield pdf.iloc[:0]

        kept = self.kept(df)
        kept.select(row_json(kept).alias("value")).mapInPandas(send, "value string").write.format("noop").mode("overwrite").save()

    stream = write


@dataclass
class WarehouseSink(Sink):
    """A warehouse table through a Spark connector's format, such as bigquery; the connector must be on the class path."""

    format: str = "bigquery"
    options: Mapping[str, str] = field(default_factory=dict)

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        self.kept(df).write.format(self.format).options(**self.options).mode("append").save()

    stream = write


@dataclass
class MultiSink(Sink):
    """Several sinks: blocks go to all at once, and the first error is raised when all are done; rows go to one after the other."""

    sinks: list[Sink] = field(default_factory=list)

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        if not self.sinks:
            return
        df = df.persist()
        try:
            with ThreadPoolExecutor(len(self.sinks)) as pool:
                results = [pool.submit(s.write, df, partition_by) for s in self.sinks]
            errors = [e for r in results if (e := r.exception())]
        finally:
            df.unpersist()
        if errors:
            raise errors[0]

    def stream(self, df: DataFrame) -> None:
        for s in self.sinks:
            s.stream(df)


def make_sink(entry: Mapping[str, Any], peers: Mapping[str, Callable[[DataFrame], Any]] | None = None) -> Sink:
    """Sinks of one configured entry, such as {file: {dir: ...}, console: {}}."""
    made: list[Sink] = []
    for name, raw in entry.items():
        o = dict(raw or {})
        base = {"filter": o.pop("filter", None), "encoder": o.pop("encoder", None)}
        if name == "file":
            made.append(FileSink(**base, directory=o["dir"]))
        elif name == "s3":
            made.append(S3Sink(**base, bucket=o["bucket"], directory=object_store("s3a", o["bucket"], o.get("prefix", "")).directory, settings={k: v for k, v in o.items() if k in S3_SETTINGS}))
        elif name == "gcs":
            made.append(object_store("gs", o["bucket"], o.get("prefix", ""), **base))
        elif name == "azure":
            made.append(AccountsSink(**base, container=o["container"], accounts=list(o.get("storageAccounts") or [o.get("account", "")]), weights=o.get("storageAccountWeights"), prefix=o.get("prefix", "")))
        elif name == "bigquery":
            made.append(WarehouseSink(**base, options={"table": f"{o['project']}.{o['dataset']}.{o['table']}"}))
        elif name == "pubsub":
            made.append(MessageSink(**base, connect=(peers or {}).get(f"{o['project']}/{o['topic']}")))
        elif name == "console":
            made.append(ConsoleSink(**base))
        elif name == "noop":
            made.append(NoopSink(**base))
        elif name == "peer":
            made.append(PeerSink(**base, ingest=(peers or {}).get(o["endpoint"])))
    if not made:
        raise ValueError(f"no known sink in {sorted(entry)}")
    return made[0] if len(made) == 1 else MultiSink(sinks=made)


def make_sinks(entries: list[Mapping[str, Any]], peers: Mapping[str, Callable] | None = None) -> MultiSink:
    return MultiSink(sinks=[make_sink(e, peers) for e in entries])
