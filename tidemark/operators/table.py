"""Hot tables: append, schemas, layout by hash and time, expiry and deletion.

Layout: <root>/<table>/schema=<n>/_expires_at=<epoch seconds>/_batch=<id>/_part=<value>/*.parquet. Every batch
keeps the schema it came with; a schema has a number and a JSON file. A batch counts once its marker stands in _committed, which is
written last and names its expiry, schema and folder; so scans and compaction see a whole batch or nothing of it, and one listing tells
what there is. All files of a batch expire together, so expiry prunes and drops whole folders. Batches, or some of their hash values, are
dropped by one file that lists them, so all of them leave new scans at once; their files go in a later purge, when scans that began before
have ended. _part is the hash value, or a bucket of it where a table is made with buckets, for keys of many values.
Rows are sorted by hash and time within files, so that Parquet's statistics prune time ranges.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.schema import Schema, parse_schema, schema_of
from tidemark.functions.scripting import Computed, log
from tidemark.functions.types import Kind
from tidemark.functions.values import estimated_size
from tidemark.operators import files
from tidemark.operators.transform import backfill, merge, transform
from tidemark.sources.readers import find_column

#: Defaults of a table: the hash and sort columns and the time to live, in seconds.
HASH_BY, SORT_BY, TTL = "event", "tsi", 3600
#: Columns that the table adds.
INGESTED, EXPIRES, BATCH, PART = "_ingested_at", "_expires_at", "_batch", "_part"
#: Seconds that files of dropped and expired batches stay for scans that are under way.
GRACE = 600
#: Seconds between looks at a schema that is kept at an address.
SCHEMA_CHECK = 300
#: Columns that say where a row stands: its file, and its place there.
FILE, ROW = "_file", "_row"
#: Folders of a batch from which buckets are advised.
MANY_FOLDERS = 1000
#: Rows from which the size of a row is estimated.
SIZED_ROWS = 1000


class Batch(NamedTuple):
    """A committed batch; its name is the id that it was given, its folder's id has the attempt that wrote it besides."""

    expiry: int
    schema: int
    id: str

    @property
    def marker(self) -> str:
        return f"{self.expiry}.{self.schema}.{self.id}"

    @property
    def name(self) -> str:
        return self.id.partition("~")[0]

    @classmethod
    def of(cls, marker: str) -> Batch:
        expiry, schema, own = marker.split(".", 2)
        return cls(int(expiry), int(schema), own)


@dataclass
class TimeSeriesTable:
    spark: SparkSession
    root: str
    name: str
    hash_by: str = HASH_BY
    sort_by: str = SORT_BY
    ttl: int = TTL
    schema_text: str | None = None
    computed: list[Computed] = field(default_factory=list)
    streams: list = field(default_factory=list)
    buckets: int = 0
    grace: int = GRACE
    rows_per_file: int = 0
    file_bytes: int = 0
    clock: Callable[[], float] = time.time
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)
    _static: tuple[float, Schema | None] = (float("-inf"), None)

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    # ------------------------------------------------------------ schemas

    def static_schema(self) -> Schema | None:
        """The configured schema: YAML text, or an address of such, looked at anew every few minutes."""
        if not self.schema_text:
            return None
        if "://" not in self.schema_text and not self.schema_text.startswith("/"):
            return parse_schema(self.schema_text)
        checked, schema = self._static
        if self.clock() - checked >= SCHEMA_CHECK:
            text = files.read_text(self.spark, self.schema_text)
            schema = parse_schema(text) if text is not None else schema
            self._static = (self.clock(), schema)
        return schema

    def _schemas(self) -> dict[int, Schema]:
        return {int(n.partition(".")[0]): Schema({c: Kind[k] for c, k in json.loads(files.read_text(self.spark, f"{self.path}/_schemas/{n}")).items()}) for n in files.children(self.spark, f"{self.path}/_schemas") if n.endswith(".json")}

    def latest_schema(self) -> Schema:
        """The static schema, or that of the last batch appended."""
        static = self.static_schema()
        if static is not None:
            return static
        number = files.read_text(self.spark, f"{self.path}/_latest")
        return self._schemas()[int(number)] if number else Schema()

    def union_schema(self) -> Schema:
        """All columns of all batches; of conflicting types the newest."""
        out = Schema()
        for _, s in sorted(self._schemas().items()):
            out.update(s)
        return Schema({**out, **(self.static_schema() or {})})

    def _number_of(self, schema: Schema) -> int:
        known = self._schemas()
        for n, s in known.items():
            if s == schema:
                return n
        n = max(known, default=0) + 1
        files.write_text(self.spark, f"{self.path}/_schemas/{n}.json", json.dumps({c: schema[c].name for c in schema.columns()}))
        return n

    # ------------------------------------------------------------ writing

    def prepare(self, df: DataFrame, exact: bool = False) -> DataFrame | None:
        """What append() would write: transformed rows that have a hash value; None without the hash column."""
        if self.hash_by:
            found = find_column(df, self.hash_by, exact)
            if found is None:
                return None
            value = F.col(found).cast("string")
            df = df.where(value.isNotNull() & (value != ""))
            if found != self.hash_by:
                df = df.withColumnRenamed(found, self.hash_by)
        return transform(df, self.static_schema(), self.computed)

    def append(self, df: DataFrame, exact: bool = False, batch: str | None = None) -> str | None:
        """Write a batch; its id, or None if it lacks the hash column. Streams get the rows as they were stored; their failures don't stop it.

        batch: a name that the batch has; if one of that name is there already, nothing is done, so a retry adds nothing."""
        rows = self.prepare(df, exact)
        if rows is None:
            return None
        if self.hash_by and self.hash_by not in rows.columns:
            raise ValueError(f"the schema of {self.name} has no column {self.hash_by!r}")
        if batch is not None:
            found = next((b.id for b in self._committed() if b.name == batch), None)
            if found:
                return found
        schema = schema_of(rows.schema)
        with self._lock:
            number = self._number_of(schema)
        now = self.clock()
        own = Batch(int(now) + self.ttl, number, uuid.uuid4().hex if batch is None else f"{batch}~{uuid.uuid4().hex[:12]}")
        part = self._part_of(F.col(self.hash_by).cast("string")) if self.hash_by else F.lit("all")
        order = [c for c in (self.hash_by, self.sort_by) if c and c in rows.columns]
        out = rows.withColumns({INGESTED: F.timestamp_micros(F.lit(int(now * 1e6))), EXPIRES: F.lit(own.expiry), BATCH: F.lit(own.id), PART: part})
        # rebalancing gathers a value's rows without putting a frequent value into one task
        out = out.hint("rebalance", F.col(PART)).sortWithinPartitions(PART, *order)
        out.write.mode("append").option("maxRecordsPerFile", self._rows_of_a_file(rows)).partitionBy(EXPIRES, BATCH, PART).parquet(f"{self.path}/schema={number}")
        with self._lock:
            files.write_text(self.spark, f"{self.path}/_latest", str(number))
        folders = files.children(self.spark, self._folder(own))
        if len(folders) > MANY_FOLDERS:
            log("warning", f"{len(folders)} values of {self.hash_by} make as many folders of a batch; a table with buckets has fewer")
        if folders:  # else there was no row
            files.write_text(self.spark, f"{self.path}/_committed/{own.marker}", "")
            if self.streams:
                publish(merge([f for _, f in self._read([own])], schema), self.streams)
        return own.id

    def _folder(self, batch: Batch) -> str:
        return f"{self.path}/schema={batch.schema}/{EXPIRES}={batch.expiry}/{BATCH}={batch.id}"

    def _rows_of_a_file(self, rows: DataFrame) -> int:
        """Rows of a file at most (0: no bound), from the size of some rows where files are bounded in bytes."""
        if not self.file_bytes:
            return self.rows_per_file
        size = rows.limit(SIZED_ROWS).agg(F.avg(estimated_size(rows))).first()[0] or 1.0
        found = max(1, int(self.file_bytes / size))
        return min(found, self.rows_per_file) if self.rows_per_file else found

    def _part_of(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("string") if self.buckets else value

    # ------------------------------------------------------------ reading

    def _committed(self) -> list[Batch]:
        """All batches that are whole, dropped ones too."""
        return [Batch.of(n) for n in files.children(self.spark, f"{self.path}/_committed") if not n.endswith(".new")]

    def batches(self) -> list[Batch]:
        """Committed batches that are neither expired nor dropped."""
        dropped, now = self._dropped(), int(self.clock())
        gone = {b for d in dropped if d["parts"] is None for b in d["batches"]}
        return [b for b in self._committed() if b.expiry > now and b.id not in gone]

    def _read(self, batches: Iterable[Batch], place: bool = False) -> list[tuple[Schema, DataFrame]]:
        """The rows of some batches, a frame for each schema; place: with the columns that say where a row stands."""
        schemas, out = self._schemas(), []
        by_schema: dict[int, list[Batch]] = {}
        for b in batches:
            by_schema.setdefault(b.schema, []).append(b)
        parts = [d for d in self._dropped() if d["parts"] is not None]
        for number, own in sorted(by_schema.items()):
            schema = schemas[number]
            fields = schema.to_spark().add(INGESTED, "timestamp").add(EXPIRES, "long").add(BATCH, "string").add(PART, "string")
            df = self.spark.read.schema(fields).option("basePath", f"{self.path}/schema={number}").parquet(*map(self._folder, own))
            for d in parts:
                df = df.where(~(F.col(BATCH).isin(d["batches"]) & F.col(PART).isin(d["parts"])))
            out.append((schema, df.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias(FILE), F.col("_metadata.row_index").alias(ROW)) if place else df))
        return out

    def scan(self, columns: Iterable[str] | None = None, hashes: Iterable | None = None, times: Iterable[tuple] = (), where: Column | None = None, place: bool = False) -> DataFrame:
        """Live rows with the asked columns (all of the latest schema by default), null where a batch lacks one.

        hashes: wanted values of the hash column. times: ranges [from, until) of the sort column, in its own type; None is open.
        place: with the columns that say where a row stands."""
        known = Schema({**self.union_schema(), **self.latest_schema()})
        wanted = list(columns) if columns is not None else self.latest_schema().columns()
        for c in wanted:
            if c not in known:
                raise ValueError(f"table {self.name} has no column {c!r}")
        values = None if hashes is None else sorted({str(h) for h in hashes})
        parts = values
        if self.buckets and values:  # literals, so that folders are pruned
            parts = list(self.spark.range(1).select(*(self._part_of(F.lit(v)).alias(f"c{i}") for i, v in enumerate(values))).first())
        frames = []
        asked = Schema({c: known[c] for c in wanted})
        extra = [FILE, ROW] if place else []
        for schema, df in self._read(self.batches(), place):
            if values is not None:
                df = df.where(F.col(PART).isin(parts))
                if self.buckets:
                    df = df.where(F.col(self.hash_by).cast("string").isin(values))
            if self.sort_by in schema:
                for low, high in times:
                    df = df.where(F.col(self.sort_by) >= F.lit(low)) if low is not None else df
                    df = df.where(F.col(self.sort_by) < F.lit(high)) if high is not None else df
            elif any(t != (None, None) for t in times):
                df = df.where(F.lit(False))
            if where is not None:
                df = backfill(df, known, extra).where(where)
            frames.append(backfill(df, asked, extra) if where is None else df.select(*sorted(wanted), *extra))
        if not frames:
            empty = asked.to_spark()
            return self.spark.createDataFrame([], empty.add(FILE, "string").add(ROW, "long") if place else empty).select(*wanted, *extra)
        return reduce(DataFrame.unionByName, frames).select(*wanted, *extra)

    def in_order(self, columns: Iterable[str], hashes: Iterable | None = None, times: Iterable[tuple] = ()) -> DataFrame:
        """A scan in the order of keys: by hash value, then by time."""
        columns = list(columns)
        order = [c for c in (self.hash_by, self.sort_by) if c]
        return self.scan(dict.fromkeys([*columns, *order]), hashes, times).orderBy(*order).select(*columns)

    def frame(self) -> DataFrame:
        """All live rows under the union of all schemas."""
        return self.scan(self.union_schema().columns())

    def splits(self) -> DataFrame:
        """split, rows: the partitions that a full scan is planned in, and the rows of each."""
        return self.frame().groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("rows"))

    def register(self, view: str | None = None) -> str:
        """Make the table a view for SQL."""
        view = view or self.name
        self.frame().createOrReplaceTempView(view)
        return view

    # ------------------------------------------------------------ upkeep

    def _dropped(self, before: float = float("inf")) -> list[dict]:
        """What was dropped (before a time, if one is given): when, the batches, and their parts, or None for all."""
        out = []
        for name in files.children(self.spark, f"{self.path}/_dropped"):
            entry = json.loads(files.read_text(self.spark, f"{self.path}/_dropped/{name}") or "{}") if name.endswith(".json") else {}
            if entry and entry["at"] < before:
                out.append({"name": name, "parts": None, **entry})
        return out

    def purge(self) -> int:
        """Delete what expired or was dropped a while ago, and what an append that failed left until it would have expired; how many folders."""
        before, gone = self.clock() - self.grace, 0

        def remove(path: str) -> None:
            nonlocal gone
            gone += files.delete(self.spark, path)

        committed = {b.id: b for b in self._committed()}
        for entry in self._dropped(before):
            for own in entry["batches"]:
                if own in committed and entry["parts"] is None:
                    files.delete(self.spark, f"{self.path}/_committed/{committed[own].marker}")
                    remove(self._folder(committed[own]))
                elif own in committed:
                    for part in entry["parts"]:
                        remove(f"{self._folder(committed[own])}/{PART}={escape(part)}")
            files.delete(self.spark, f"{self.path}/_dropped/{entry['name']}")
        for own in committed.values():
            if own.expiry <= before:
                files.delete(self.spark, f"{self.path}/_committed/{own.marker}")
        for folder in files.children(self.spark, self.path):
            for expiry in files.children(self.spark, f"{self.path}/{folder}") if folder.startswith("schema=") else []:
                if expiry.startswith(f"{EXPIRES}="):
                    at = f"{self.path}/{folder}/{expiry}"
                    if int(expiry.partition("=")[2]) <= before:
                        for own in files.children(self.spark, at):
                            remove(f"{at}/{own}")
                    if not files.children(self.spark, at):
                        files.delete(self.spark, at)
        return gone

    def _drop(self, batches: list[str], parts: list[str] | None = None) -> None:
        files.write_text(self.spark, f"{self.path}/_dropped/{uuid.uuid4().hex}.json", json.dumps({"at": self.clock(), "batches": batches, "parts": parts}))

    def delete_batches(self, batches: Iterable[str]) -> int:
        """Drop batches from all later scans, all at once; how many."""
        gone = sorted({b.id for b in self.batches()} & set(batches))
        if gone:
            self._drop(gone)
        return len(gone)

    def delete_hashes(self, values: Iterable) -> int:
        """Drop all rows of some hash values from all later scans, all at once; how many folders. Not for tables with buckets."""
        if self.buckets:
            raise ValueError("a table with buckets keeps several values in a folder")
        parts = sorted({str(v) for v in values})
        names = {f"{PART}={escape(v)}" for v in parts}
        held = {b.id: len(names & set(files.children(self.spark, self._folder(b)))) for b in self.batches()}
        if any(held.values()):
            self._drop(sorted(b for b, n in held.items() if n), parts)
        return sum(held.values())


def escape(value: str) -> str:
    """A value as it stands in the name of a partition's folder."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)


def publish(rows: DataFrame, streams: Iterable) -> list[Exception]:
    """Give rows to streaming sinks; failures are logged and returned, and stop neither the others nor the caller."""
    failures: list[Exception] = []
    for sink in streams:
        try:
            sink.stream(rows)
        except Exception as e:  # a stream must not hold up ingestion
            log("error", f"stream {sink!r}: {e}")
            failures.append(e)
    return failures
