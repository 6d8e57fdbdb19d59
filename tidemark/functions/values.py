"""Conversions and generated values as column expressions: strict parsing, epochs, identifiers, sizes."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import Kind

#: The spellings of the two truth values (fixed values).
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL = r"^(?i)([+-]?(inf|infinity)|nan)$"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
#: Epoch values after this instant, in a unit, are taken to be in that unit.
UNITS_FROM = datetime(2010, 1, 1, tzinfo=UTC)


def parse_bool(text: Column) -> Column:
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def parse_int(text: Column, kind: Kind) -> Column:
    """Base 10 with an optional sign and nothing else; null if out of range."""
    return F.when(text.rlike(INTEGER), text.try_cast(kind.spark))


def parse_float(text: Column) -> Column:
    low = F.lower(text)
    special = F.when(low == "nan", float("nan")).when(low.startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(text.rlike(NUMBER), text.try_cast("double")).when(text.rlike(SPECIAL), special)


def parse_timestamp(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


def parse_text(text: Column, kind: Kind) -> Column:
    """Text as a value of a type; null where it doesn't parse, never an error."""
    if kind is Kind.BOOL:
        return parse_bool(text)
    if kind in (Kind.INT32, Kind.INT64):
        return parse_int(text, kind)
    if kind is Kind.FLOAT64:
        return parse_float(text)
    if kind is Kind.TIMESTAMP:
        return parse_timestamp(text)
    return text


def from_epoch(value: Column) -> Column:
    """An integer epoch as a timestamp; its size tells whether it counts nano-, micro-, milliseconds or seconds."""
    start = int(UNITS_FROM.timestamp())
    return (
        F.when(value > F.lit(start * 10**9), F.timestamp_micros(_div(value, 1000)))
        .when(value > F.lit(start * 10**6), F.timestamp_micros(value))
        .when(value > F.lit(start * 10**3), F.timestamp_millis(value))
        .otherwise(F.timestamp_seconds(value))
    )


def _div(value: Column, by: int) -> Column:
    """Whole division that keeps all digits of a long."""
    return F.floor(value.cast("decimal(20,0)") / F.lit(by)).cast("long")


def seconds_to_timestamp(value: Column) -> Column:
    return F.timestamp_seconds(value)


def narrow(value: Column) -> Column:
    """A long as an int; null beyond its range, as wrapped values would mislead."""
    return value.try_cast("int")


def identifier() -> Column:
    """A new 32-digit hexadecimal identifier for each row, ordered by time."""
    return F.concat(F.lpad(F.lower(F.hex(F.unix_micros(F.current_timestamp()))), 16, "0"), F.substr(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(17), F.lit(16)))


def current_second() -> Column:
    return F.date_trunc("second", F.current_timestamp())


#: Generators that computed columns can name.
GENERATORS = {"make://identifier": (identifier, Kind.STRING), "make://timestamp": (current_second, Kind.TIMESTAMP)}

#: Bytes of a value besides the null mark, which takes NULL_BYTES (fixed values).
WIDTHS = {T.IntegerType: 4, T.LongType: 8, T.DoubleType: 8, T.BooleanType: 1, T.TimestampType: 8, T.TimestampNTZType: 8}
NULL_BYTES, LENGTH_BYTES = 2, 4


def estimated_size(df: DataFrame) -> Column:
    """Bytes that a row takes in columns, for use in sum()."""
    parts = []
    for f in df.schema:
        width = WIDTHS.get(type(f.dataType))
        value = F.col(f"`{f.name}`")
        parts.append(F.lit(NULL_BYTES + width) if width else F.lit(NULL_BYTES + LENGTH_BYTES) + F.coalesce(F.octet_length(value.cast("string")), F.lit(0)))
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + p
    return total


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's named values; the same in every run."""
    return F.xxhash64(*(x for c in sorted(df.columns) for x in (F.lit(c), F.col(f"`{c}`").cast("string"))))


def pack_others(df: DataFrame, kept: list[str], into: str = "data") -> DataFrame:
    """The kept columns, and all others as one JSON object without nulls."""
    others = [c for c in df.columns if c not in kept]
    return df.select(*(F.col(f"`{c}`") for c in kept), F.to_json(F.struct(*(F.col(f"`{c}`") for c in others))).alias(into) if others else F.lit("{}").alias(into))


def row_json(df: DataFrame) -> Column:
    """A row as JSON: its values without nulls, and the types of its columns."""
    from tidemark.functions.schema import schema_of

    kinds = schema_of(df.schema)
    values = F.struct(*(F.col(f"`{c}`") for c in kinds.columns()))
    types = F.struct(*(F.lit(kinds[c].sql).alias(c) for c in kinds.columns()))
    return F.to_json(F.struct(values.alias("Values"), types.alias("Schema")))
