"""Schemas as mappings from column names to types, and their algebra."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import yaml
from pyspark.sql import types as T

from tidemark.functions.types import CONVERTIBLE, MARK, Kind, kind_of, parse_kind

VALID_NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


class Schema(dict[str, Kind]):
    """Column names and types; the order carries no meaning, listings are by name."""

    def columns(self) -> list[str]:
        return sorted(self)

    def describe(self) -> str:
        """JSON by name, with SQL type names."""
        return json.dumps({c: self[c].sql for c in self.columns()})

    def missing_from(self, desired: Mapping[str, Kind]) -> Schema:
        """What desired has and this lacks or has with another type."""
        return Schema({c: k for c, k in desired.items() if self.get(c) is not k})

    def without(self, other: Mapping[str, Kind]) -> Schema:
        """Columns whose names the other doesn't have."""
        return Schema({c: k for c, k in self.items() if c not in other})

    def union(self, other: Mapping[str, Kind]) -> tuple[Schema, bool]:
        """All columns of both and True; on a conflict of types this schema alone and False."""
        if any(self.get(c, k) is not k for c, k in other.items()):
            return self.clone(), False
        return Schema({**self, **other}), True

    def contains(self, column: str, kind: Kind) -> bool:
        return self.get(column) is kind

    def target_of(self, column: str, kind: Kind) -> Kind | None:
        """The type in this schema that a column of that name and type can become, if any."""
        own = self.get(column)
        return own if own is not None and own in CONVERTIBLE[kind] else None

    def clone(self) -> Schema:
        return Schema(self)

    def to_spark(self) -> T.StructType:
        """Fields by name; JSON columns are marked strings."""
        return T.StructType([T.StructField(c, self[c].spark, True, {MARK: Kind.JSON.name} if self[c] is Kind.JSON else {}) for c in self.columns()])


def schema_of(fields: T.StructType, source: str = "memory") -> Schema:
    """The supported, validly named columns of a Spark schema."""
    found = {f.name: kind_of(f, source) for f in fields if VALID_NAME.match(f.name)}
    return Schema({c: k for c, k in found.items() if k is not None})


def parse_schema(text: str) -> Schema:
    """A schema in YAML, `column: type`; columns of unknown types are left out."""
    found = {str(c): parse_kind(str(t)) for c, t in (yaml.safe_load(text) or {}).items()}
    return Schema({c: k for c, k in found.items() if k is not None})
