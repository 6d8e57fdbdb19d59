"""System tables: the node and its log."""

from __future__ import annotations

import json
import logging
import socket
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.schema import Schema
from tidemark.functions.types import Kind
from tidemark.operators import files

NODES = Schema({"address": Kind.STRING, "public": Kind.STRING, "private": Kind.STRING, "started": Kind.INT64, "uptime": Kind.STRING, "peers": Kind.STRING})
LOGS = Schema({"time": Kind.TIMESTAMP, "address": Kind.STRING, "level": Kind.STRING, "message": Kind.STRING})
#: Seconds that log rows live, and rows in memory that go to a file.
LOG_TTL, FLUSH = 24 * 3600, 10_000


def duration(seconds: int) -> str:
    """Such as `1 day 2 hours 5 seconds`."""
    parts = []
    for name, size in (("day", 86_400), ("hour", 3_600), ("minute", 60), ("second", 1)):
        n, seconds = divmod(seconds, size)
        if n:
            parts.append(f"{n} {name}{'s' if n > 1 else ''}")
    return " ".join(parts) or "0 seconds"


def nodes(spark: SparkSession) -> DataFrame:
    """One row: the driver, and the executors as its peers."""
    sc = spark.sparkContext
    host = spark.conf.get("spark.driver.host", socket.gethostname())
    started = sc.startTime // 1000
    members = sc._jsc.sc().getExecutorMemoryStatus().keys().toList()
    peers = sorted(members.apply(i) for i in range(members.size()))
    try:
        public = socket.gethostbyname(socket.gethostname())
    except OSError:
        public = host
    row = (host, json.dumps([host]), json.dumps(peers), public, started, duration(int(time.time()) - started))
    return spark.createDataFrame([row], "address string, private string, peers string, public string, started long, uptime string").select(*NODES.columns())


class LogTable(logging.Handler):
    """The engine's log as a table; rows expire after a day. Attach it to a logger.

    The latest rows are in memory; every FLUSH rows go to a file under path, so a busy day's log is neither cut nor held here."""

    def __init__(self, spark: SparkSession, path: str | None = None, ttl: int = LOG_TTL, flush: int = FLUSH):
        super().__init__()
        self.spark, self.path, self.ttl, self.flush_at = spark, path, ttl, flush
        self.rows: list[tuple] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.append(record.getMessage(), record.levelname.lower(), record.created)

    def append(self, message: str, level: str = "info", at: float | None = None) -> None:
        self.rows.append((datetime.fromtimestamp(time.time() if at is None else at, UTC), socket.gethostname(), level, message))
        if self.path and len(self.rows) >= self.flush_at:
            self.store()

    def store(self) -> None:
        """Move the rows in memory to a file, and remove files of expired rows."""
        rows, self.rows = self.rows, []
        if rows:
            last = int(max(r[0] for r in rows).timestamp())
            lines = [json.dumps(dict(zip(("time", "address", "level", "message"), (r[0].isoformat(), *r[1:]), strict=True))) for r in rows]
            files.write_text(self.spark, f"{self.path}/{last}-{uuid.uuid4().hex}.json", "\n".join(lines))
        for name in files.children(self.spark, self.path):
            if name.endswith(".json") and int(name.partition("-")[0]) < time.time() - self.ttl - 1:
                files.delete(self.spark, f"{self.path}/{name}")

    def frame(self) -> DataFrame:
        live = datetime.fromtimestamp(time.time() - self.ttl, UTC)
        kind = "time timestamp, address string, level string, message string"
        rows = self.spark.createDataFrame(list(self.rows), kind)
        if self.path and any(n.endswith(".json") for n in files.children(self.spark, self.path)):
            rows = rows.union(self.spark.read.schema(kind).json(f"{self.path}/*.json"))
        return rows.where(F.col("time") > F.lit(live)).select(*(F.col(c) for c in LOGS.columns()))
