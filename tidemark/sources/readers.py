"""Batch sources: event lists, CSV, ORC, Parquet and URLs, all as frames of the seven types."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.schema import VALID_NAME, Schema
from tidemark.functions.types import MARK, Kind, kind_of
from tidemark.functions.values import parse_text
from tidemark.operators.transform import named, normalise


def _kind_of_value(value: Any) -> Kind:
    if isinstance(value, bool):
        return Kind.BOOL
    if isinstance(value, int):
        return Kind.INT64
    if isinstance(value, float):
        return Kind.FLOAT64
    if isinstance(value, datetime):
        return Kind.TIMESTAMP
    return Kind.JSON if isinstance(value, dict | list) else Kind.STRING


def _as_text(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime):
        return value.isoformat()
    return json.dumps(value) if isinstance(value, dict | list) else str(value)


def _encoded(value: Any, kind: Kind) -> Any:
    """A value as a column of that kind holds it."""
    return _as_text(value) if value is not None and kind in (Kind.STRING, Kind.JSON) and not isinstance(value, str) else value


def from_events(spark: SparkSession, events: Iterable[Mapping[str, Any]], json_numbers: bool = False) -> DataFrame:
    """A client's batch of events. Absent and null values are null; nested values become JSON text.

    A column whose values differ in type becomes text, which a static schema can parse. json_numbers: all numbers are
    floating-point, as in events that came as JSON. For batches that a client holds in memory; use files, streams or from_rows for more."""
    rows = [{k: float(v) if json_numbers and isinstance(v, int) and not isinstance(v, bool) else v for k, v in e.items() if v is not None and VALID_NAME.match(k)} for e in events]
    kinds: dict[str, Kind] = {}
    for row in rows:
        for k, v in row.items():
            own = _kind_of_value(v)
            kinds[k] = own if kinds.get(k, own) is own else Kind.STRING
    schema = Schema(kinds)
    data = [tuple(_encoded(row.get(c), schema[c]) for c in schema.columns()) for row in rows]
    if not schema:
        return spark.createDataFrame([() for _ in rows], T.StructType([]))
    return spark.createDataFrame(data, schema.to_spark())


def from_rows(df: DataFrame) -> DataFrame:
    """Rows of a frame as a client's events: each value goes through the same encoder, on the executors, and none through the driver.

    A column's kind is that of its type, not of the values that come, so a column without any stays. Times stay as they are, with a zone or
    without, as Python's end with the year 9999."""
    own = {f.name: f for f in df.schema if VALID_NAME.match(f.name)}
    found = {c: kind_of(f) or Kind.STRING for c, f in own.items()}
    kinds = Schema({c: Kind.INT64 if k is Kind.INT32 else k for c, k in found.items()})
    names = kinds.columns()
    if not names:
        return df.select()
    times = {c for c in names if kinds[c] is Kind.TIMESTAMP}
    types = {c: to_arrow_type(kinds[c].spark) for c in names if c not in times}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(c) if c in times else pa.array([_encoded(v, kinds[c]) for v in b.column(c).to_pylist(maps_as_pydicts="lossy")], types[c]) for c in names], names)

    return df.select(*names).mapInArrow(encode, T.StructType([own[f.name] if f.name in times else f for f in kinds.to_spark()]))


def from_csv(spark: SparkSession, path: str | list[str], schema: Schema | None = None) -> DataFrame:
    """Files with a header; a row with another number of fields is an error. Cells are text, parsed to the schema's types.

    An empty cell is the empty text, so it is null in all columns but texts."""
    raw = spark.read.options(header=True, mode="FAILFAST", enforceSchema=False, inferSchema=False).csv(path)
    out = []
    for f in raw.schema:
        if VALID_NAME.match(f.name):
            kind = (schema or {}).get(f.name, Kind.STRING)
            out.append(named(parse_text(F.coalesce(F.col(f.name), F.lit("")), kind), f.name, kind))
    return raw.select(*out)


def from_orc(spark: SparkSession, path: str | list[str], schema: Schema | None = None) -> DataFrame:
    return normalise(spark.read.orc(path), "orc")


def from_parquet(spark: SparkSession, path: str | list[str], schema: Schema | None = None) -> DataFrame:
    return normalise(spark.read.parquet(*([path] if isinstance(path, str) else path)), "parquet")


FORMATS: dict[str, Callable[..., DataFrame]] = {"orc": from_orc, "csv": from_csv, "parquet": from_parquet}


def from_url(spark: SparkSession, uri: str, schema: Schema | None = None) -> DataFrame:
    """An object at any address that Spark reads; its extension says the format."""
    extension = uri.rstrip("/").rpartition(".")[2].lower()
    if extension not in FORMATS:
        raise ValueError(f"unsupported file extension {extension!r} in {uri}")
    return FORMATS[extension](spark, uri, schema)


def from_request(spark: SparkSession, request: Mapping[str, Any], schema: Schema | None = None) -> DataFrame | None:
    """A request holds one of batch (events), csv, orc, parquet (paths) or url; an empty one gives None."""
    if request.get("batch") is not None:
        return from_events(spark, request["batch"])
    if request.get("url"):
        return from_url(spark, request["url"], schema)
    for name, read in FORMATS.items():
        if request.get(name):
            return read(spark, request[name], schema)
    if request:
        raise ValueError(f"unsupported request: {sorted(request)}")
    return None


def first(df: DataFrame, columns: list[str] | None = None) -> Row | None:
    """The first row, reading only the asked columns."""
    return (df.select(*columns) if columns else df).first()


def rows(df: DataFrame, columns: list[str] | None = None) -> Iterator[Row]:
    """All rows, a partition at a time."""
    return (df.select(*columns) if columns else df).toLocalIterator()


def find_column(df: DataFrame, name: str, exact: bool = False) -> str | None:
    """The column of that name; in files, letter case is ignored where no column has exactly that name."""
    if name in df.columns:
        return name
    return None if exact else next((c for c in df.columns if c.lower() == name.lower()), None)


def mark_json(df: DataFrame, *columns: str) -> DataFrame:
    """Say that text columns hold JSON."""
    return df.select(*(F.col(f"`{c}`").alias(c, metadata={MARK: Kind.JSON.name}) if c in columns else F.col(f"`{c}`") for c in df.columns))
