"""The seven column types, their names, and how they map to Spark's types."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind(Enum):
    """A column type. JSON columns hold JSON text."""

    INT32 = "INTEGER"
    INT64 = "BIGINT"
    FLOAT64 = "DOUBLE"
    STRING = "VARCHAR"
    BOOL = "BOOLEAN"
    TIMESTAMP = "TIMESTAMP"
    JSON = "JSON"

    @property
    def sql(self) -> str:
        return self.value

    @property
    def spark(self) -> T.DataType:
        return SPARK[self]


SPARK = {
    Kind.INT32: T.IntegerType(),
    Kind.INT64: T.LongType(),
    Kind.FLOAT64: T.DoubleType(),
    Kind.STRING: T.StringType(),
    Kind.BOOL: T.BooleanType(),
    Kind.TIMESTAMP: T.TimestampType(),
    Kind.JSON: T.StringType(),
}

#: Names of the types in configurations (fixed values; letter case is ignored).
ALIASES = {
    Kind.INT32: ("int32", "integer", "uint32"),
    Kind.INT64: ("int64", "bigint", "long", "uint64"),
    Kind.FLOAT64: ("float64", "double"),
    Kind.STRING: ("string", "text", "varchar"),
    Kind.BOOL: ("bool", "boolean"),
    Kind.TIMESTAMP: ("timestamp", "time"),
    Kind.JSON: ("json", "map"),
}
_BY_NAME = {alias: kind for kind, aliases in ALIASES.items() for alias in aliases}

#: Strings can become any type by parsing; JSON is also text; all others only stay what they are.
CONVERTIBLE = {kind: {kind} for kind in Kind} | {Kind.STRING: {*Kind}, Kind.JSON: {Kind.JSON, Kind.STRING}}

#: Spark types that each file format brings in (others are dropped). Nested values become JSON text.
_COMMON = {T.BooleanType: Kind.BOOL, T.IntegerType: Kind.INT32, T.LongType: Kind.INT64, T.FloatType: Kind.FLOAT64, T.DoubleType: Kind.FLOAT64, T.StringType: Kind.STRING, T.VarcharType: Kind.STRING, T.TimestampType: Kind.TIMESTAMP, T.TimestampNTZType: Kind.TIMESTAMP}
_NESTED = {T.ArrayType: Kind.JSON, T.MapType: Kind.JSON, T.StructType: Kind.JSON}
ACCEPTED = {
    "orc": _COMMON | _NESTED,
    "parquet": _COMMON | _NESTED | {T.ByteType: Kind.INT32, T.ShortType: Kind.INT32, T.BinaryType: Kind.STRING},
    "memory": _COMMON | _NESTED | {T.ByteType: Kind.INT32, T.ShortType: Kind.INT32, T.BinaryType: Kind.STRING},
}
#: The key under which a Spark field keeps that its text is JSON.
MARK = "kind"


def parse_kind(name: str) -> Kind | None:
    """The type of that name, or None for names that are no type."""
    return _BY_NAME.get(name.strip().lower())


def kind_of(field: T.StructField, source: str = "memory") -> Kind | None:
    """The type that a Spark field comes in as, or None if the source's type is not supported."""
    if (field.metadata or {}).get(MARK) == Kind.JSON.name:
        return Kind.JSON
    return ACCEPTED[source].get(type(field.dataType))


def as_kind(column: Column, field: T.StructField, kind: Kind) -> Column:
    """A Spark column as the column of its type: nested values as JSON text, bytes as UTF-8 text, small types widened."""
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(column)
    if isinstance(field.dataType, T.BinaryType):
        return F.decode(column, "UTF-8")
    return column if field.dataType == kind.spark or isinstance(field.dataType, T.TimestampNTZType) else column.cast(kind.spark)
