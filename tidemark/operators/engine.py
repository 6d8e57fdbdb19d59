"""The engine: tables by name, ingestion into them, scans, metadata, and SQL over views."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import Config, TableConfig
from tidemark.functions.scripting import Computed, log
from tidemark.operators import system
from tidemark.operators.compact import Compactor
from tidemark.operators.scan import scan
from tidemark.operators.sinks import make_sink, make_sinks
from tidemark.operators.table import TimeSeriesTable
from tidemark.sources.readers import from_events, from_request


@dataclass
class Counter:
    calls: int = 0
    failures: int = 0
    seconds: float = 0.0


def traced(f: Callable) -> Callable:
    """Count an engine's requests and log each with its time; for queries that is the time of planning."""

    @functools.wraps(f)
    def run(self, *args, **options):
        counter, began = self.counters.setdefault(f.__name__, Counter()), time.perf_counter()
        counter.calls += 1
        try:
            return f(self, *args, **options)
        except Exception as e:
            counter.failures += 1
            log("warning", f"{f.__name__} failed: {e}")
            raise
        finally:
            took = time.perf_counter() - began
            counter.seconds += took
            log("debug", f"{f.__name__} took {1000 * took:.0f} ms")

    return run


class Engine:
    def __init__(self, spark: SparkSession, root: str, schema: str = "data"):
        self.spark, self.root, self.schema = spark, root, schema
        self.tables: dict[str, TimeSeriesTable] = {}
        self.compactors: dict[str, Compactor] = {}
        self.counters: dict[str, Counter] = {}
        self.log = system.LogTable(spark, f"{root.rstrip('/')}/_logs")
        logger = logging.getLogger("tidemark")
        logger.addHandler(self.log)
        logger.setLevel(logging.INFO)

    @classmethod
    def from_config(cls, spark: SparkSession, config: Config, peers: Mapping[str, Any] | None = None) -> Engine:
        engine = cls(spark, config.storage_dir, config.schema)
        for name, table in config.tables.items():
            engine.add_table(name, table, config.computed, peers)
        return engine

    def add_table(self, name: str, config: TableConfig | None = None, computed: Iterable[Computed] = (), peers: Mapping[str, Any] | None = None, **options: Any) -> TimeSeriesTable:
        c = config or TableConfig()
        settings = {"hash_by": c.hash_by, "sort_by": c.sort_by, "ttl": c.ttl, "schema_text": c.schema, "streams": [make_sink(s, peers) for s in c.streams]} | options
        table = TimeSeriesTable(self.spark, self.root, name, computed=list(computed), **settings)
        self.tables[name] = table
        if c.compact:
            self.compactors[name] = Compactor(table, make_sinks(c.compact.sinks, peers), c.compact.name_func, c.compact.interval)
        return table

    # ------------------------------------------------------------ ingestion

    @traced
    def ingest(self, request: Mapping[str, Any] | DataFrame | list, tables: Iterable[str] | None = None, batch: str | None = None) -> dict[str, str | None]:
        """Append to all tables, or to those named (unknown names are passed over): the batch's id by table.

        A table whose hash column the data lacks gets nothing, and None. batch: a name for the batch; one that a table has already adds nothing."""
        chosen = self.tables if tables is None else {n: self.tables[n] for n in tables if n in self.tables}
        out: dict[str, str | None] = {}
        for name, table in chosen.items():
            exact = False
            if isinstance(request, DataFrame):
                df = request
            elif isinstance(request, list):
                df, exact = from_events(self.spark, request), True
            else:
                df, exact = from_request(self.spark, request, table.static_schema()), "batch" in request
            if df is not None:
                out[name] = table.append(df, exact, batch)
        return out

    # ------------------------------------------------------------ queries

    @traced
    def scan(self, table: str, columns: Iterable[str] | None = None, filters: Iterable[str] = ()) -> DataFrame:
        return scan(self.tables[table], columns, filters)

    @traced
    def sql(self, text: str) -> DataFrame:
        """SQL over all tables and system tables, as views of their names."""
        for table in self.tables.values():
            table.register()
        self.nodes().createOrReplaceTempView("nodes")
        self.log.frame().createOrReplaceTempView("logs")
        return self.spark.sql(text)

    # ------------------------------------------------------------ metadata

    def schemas(self) -> DataFrame:
        return self.spark.createDataFrame([(self.schema,)], "schema string")

    def list_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(self.schema, n) for n in sorted([*self.tables, "nodes", "logs"])], "schema string, table string")

    def describe_table(self, name: str) -> DataFrame:
        """table, column, type, and the hash and sort columns; columns by name."""
        fixed = {"nodes": (system.NODES, "", "address"), "logs": (system.LOGS, "", "time")}
        if name in fixed:
            schema, hash_by, sort_by = fixed[name]
        else:
            t = self.tables[name]
            schema, hash_by, sort_by = t.latest_schema(), t.hash_by, t.sort_by
        rows = [(name, c, schema[c].sql, hash_by, sort_by) for c in schema.columns()]
        return self.spark.createDataFrame(rows, "table string, column string, type string, hash_by string, sort_by string")

    def describe(self) -> DataFrame:
        out = self.describe_table("logs").union(self.describe_table("nodes"))
        for name in sorted(self.tables):
            out = out.union(self.describe_table(name))
        return out

    def nodes(self) -> DataFrame:
        return system.nodes(self.spark)

    def metrics(self) -> DataFrame:
        """request, calls, failures, seconds: of what was asked of this engine so far."""
        rows = [(name, c.calls, c.failures, c.seconds) for name, c in sorted(self.counters.items())]
        return self.spark.createDataFrame(rows, "request string, calls long, failures long, seconds double")

    # ------------------------------------------------------------ upkeep

    def maintain(self) -> dict[str, int]:
        """Drop what has expired; batches by table."""
        return {n: t.purge() for n, t in self.tables.items()}

    @traced
    def compact(self) -> dict[str, int]:
        return {n: c.compact() for n, c in self.compactors.items()}

    def close(self) -> None:
        for c in self.compactors.values():
            c.close()
        logging.getLogger("tidemark").removeHandler(self.log)
