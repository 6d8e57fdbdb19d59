"""Compaction: the live batches of a table are merged under their union schema, written to sinks, and dropped."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schema import Schema
from tidemark.functions.scripting import expression, log
from tidemark.functions.types import Kind
from tidemark.operators.sinks import MultiSink, Sink
from tidemark.operators.table import BATCH, EXPIRES, PART, TimeSeriesTable
from tidemark.operators.transform import merge

#: Seconds between compactions where none is given.
INTERVAL = 30
#: Folders of the default name: the day of writing (UTC), and the hash value.
DEFAULT_FOLDERS = ("year", "month", "day")


def default_folders(now: Column | None = None) -> dict[str, Column]:
    now = F.current_timestamp() if now is None else now
    return {"year": F.year(now), "month": F.month(now), "day": F.dayofmonth(now)}


def folders_of(df: DataFrame, code: str) -> Column:
    """A file-name function's value for each row; rows of one name go to one folder."""
    return expression(df, code, Kind.STRING)


@dataclass
class Compactor:
    table: TimeSeriesTable
    sink: Sink
    name_func: str | None = None
    interval: float = INTERVAL
    _stop: threading.Event = field(default_factory=threading.Event, repr=False)
    _thread: threading.Thread | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if isinstance(self.sink, MultiSink) and not self.sink.sinks:
            raise ValueError("compaction without a sink would lose data")

    def merged(self) -> tuple[DataFrame | None, list[str]]:
        """The rows of the batches that are live now, and just these batches' ids; what comes in meanwhile waits for the next round."""
        live = self.table.batches()
        if not live:
            return None, []
        frames = [df.drop(EXPIRES, BATCH, PART) for _, df in self.table._read(live)]
        return merge(frames, self.table.union_schema()), [b.id for b in live]

    def compact(self) -> int:
        """One round: write, and only then drop; how many batches. A failure keeps the batches, so rows may be written twice."""
        df, batches = self.merged()
        if df is None:
            return 0
        hash_by = self.table.hash_by
        if self.name_func:
            named, folders = df.withColumn("name", folders_of(df, self.name_func)), ("name",)
        else:
            named, folders = df.withColumns(default_folders()), DEFAULT_FOLDERS
        if hash_by:
            part = f"by_{hash_by}"
            named, folders = named.withColumn(part, F.col(hash_by).cast("string")), (*folders, part)
        named = named.hint("rebalance", *map(F.col, folders)).sortWithinPartitions(*folders, *([self.table.sort_by] if self.table.sort_by in df.columns else []))
        self.sink.write(named, folders)
        return self.table.delete_batches(batches)

    def everything(self, columns: list[str], read: Callable[[], DataFrame]) -> DataFrame:
        """Hot rows, and those already compacted, which read() gives; null where either lacks a column."""
        known = self.table.union_schema()
        asked = Schema({c: known[c] for c in columns})
        return merge([self.table.scan(columns), read()], asked).select(*columns)

    def start(self) -> None:
        """Compact every interval until close()."""

        def loop() -> None:
            while not self._stop.wait(self.interval):
                try:
                    self.compact()
                except Exception as e:  # tried again in the next round
                    log("error", f"compaction of {self.table.name}: {e}")

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def close(self) -> int:
        """Stop, and compact what is left."""
        self._stop.set()
        if self._thread:
            self._thread.join()
        return self.compact()


def every(seconds: float, action: Callable[[], object]) -> Callable[[], None]:
    """Run upkeep, such as a table's purge, again and again; calling the result ends it."""
    stop = threading.Event()

    def loop() -> None:
        while not stop.wait(seconds):
            action()

    threading.Thread(target=loop, daemon=True).start()
    return stop.set
