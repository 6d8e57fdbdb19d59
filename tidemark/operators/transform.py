"""Row transformations: schema filters, computed columns, null backfill and chains of functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schema import VALID_NAME, Schema, schema_of
from tidemark.functions.scripting import Computed
from tidemark.functions.types import MARK, Kind, as_kind, kind_of
from tidemark.functions.values import parse_text


def named(column: Column, name: str, kind: Kind) -> Column:
    return column.alias(name, metadata={MARK: Kind.JSON.name} if kind is Kind.JSON else {})


def normalise(df: DataFrame, source: str = "memory") -> DataFrame:
    """Only columns with valid names and supported types; nested values as JSON text."""
    kept = [(f, kind) for f in df.schema if VALID_NAME.match(f.name) and (kind := kind_of(f, source))]
    return df.select(*(named(as_kind(F.col(f.name), f, kind), f.name, kind) for f, kind in kept))


def transform(df: DataFrame, schema: Schema | None = None, computed: Iterable[Computed] = ()) -> DataFrame:
    """Columns that the schema has, converted to its types, and computed columns.

    Computed columns see the incoming columns, not each other. One replaces an incoming column of its name; where a schema is given,
    one that the schema lacks with exactly its type is left out."""
    present = schema_of(df.schema)
    out: dict[str, Column] = {}
    for name, kind in present.items():
        target = kind if schema is None else schema.target_of(name, kind)
        if target is not None:
            out[name] = named(parse_text(F.col(name), target) if kind in (Kind.STRING, Kind.JSON) and target is not kind else F.col(name), name, target)
    for c in computed:
        if schema is None or schema.contains(c.name, c.kind):
            out[c.name] = c.column(df)
    return df.select(*out.values())


def backfill(df: DataFrame, wanted: Schema, extra: Iterable[str] = ()) -> DataFrame:
    """Exactly the wanted columns, by name, and the extra ones as they are; wanted ones that are missing or of another type are null."""
    present = schema_of(df.schema)
    return df.select(*(named(F.col(c) if present.get(c) is k else F.lit(None).cast(k.spark), c, k) for c, k in sorted(wanted.items())), *extra)


def merge(frames: list[DataFrame], schema: Schema | None = None) -> DataFrame:
    """All rows of all frames under one schema: the given one, or the union, in which the first type of a name holds."""
    if schema is None:
        schema = Schema()
        for f in frames:
            schema = Schema({**schema_of(f.schema), **schema})
    return reduce(DataFrame.unionByName, [backfill(f, schema) for f in frames])


def chain(df: DataFrame, functions: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The functions, one after the other."""
    return reduce(lambda frame, f: frame.transform(f), functions, df)
