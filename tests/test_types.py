"""Types, schema algebra and strict parsing."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schema import Schema, parse_schema, schema_of
from tidemark.functions.types import CONVERTIBLE, Kind, parse_kind
from tidemark.functions.values import from_epoch, parse_float, parse_int, parse_text

LEFT = Schema({"b": Kind.STRING, "a": Kind.INT32})


def test_algebra():
    assert LEFT.missing_from({"b": Kind.STRING, "a": Kind.INT64, "c": Kind.JSON}) == {"a": Kind.INT64, "c": Kind.JSON}
    assert LEFT.union({"a": Kind.INT32, "c": Kind.JSON}) == ({"a": Kind.INT32, "b": Kind.STRING, "c": Kind.JSON}, True)
    assert LEFT.union({"a": Kind.INT64, "c": Kind.JSON}) == (LEFT, False)
    assert LEFT.without({"a": Kind.INT64}) == {"b": Kind.STRING}
    assert LEFT.contains("a", Kind.INT32) and not LEFT.contains("a", Kind.INT64)
    assert LEFT.columns() == ["a", "b"] and LEFT.describe() == '{"a": "INTEGER", "b": "VARCHAR"}'
    assert LEFT.target_of("a", Kind.STRING) is Kind.INT32 and LEFT.target_of("a", Kind.INT64) is None and LEFT.target_of("z", Kind.INT32) is None


kinds = st.dictionaries(st.sampled_from("abcde"), st.sampled_from(list(Kind)))


@given(kinds, kinds)
def test_union_laws(a, b):
    both, clean = Schema(a).union(b)
    assert clean == all(a.get(c, k) is k for c, k in b.items())
    assert set(both) == (set(a) | set(b) if clean else set(a))
    assert not both.missing_from(a)


def test_names_and_conversion():
    assert parse_kind("  BigInt ") is Kind.INT64 and parse_kind("map") is Kind.JSON and parse_kind("decimal") is None
    assert CONVERTIBLE[Kind.STRING] == set(Kind) and CONVERTIBLE[Kind.JSON] == {Kind.JSON, Kind.STRING} and CONVERTIBLE[Kind.INT32] == {Kind.INT32}
    assert parse_schema("{a: int64, b: time, c: nonsense}") == {"a": Kind.INT64, "b": Kind.TIMESTAMP}


def test_spark_schema_round_trip():
    schema = Schema({"a": Kind.JSON, "b": Kind.STRING, "t": Kind.TIMESTAMP})
    assert schema_of(schema.to_spark()) == schema
    assert schema_of(T.StructType().add("/x", T.IntegerType()).add("d", T.DateType()).add("ok", T.LongType())) == {"ok": Kind.INT64}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("text", "kind", "value"), [("1234", Kind.INT64, 1234), ("1234", Kind.INT32, 1234), ("1234XX", Kind.INT32, None), ("1234.00", Kind.FLOAT64, 1234.0), ("9999999999", Kind.INT32, None), ("+5", Kind.INT32, 5), (" 5", Kind.INT32, None), ("y", Kind.BOOL, None), ("T", Kind.BOOL, True), ("1.5d", Kind.FLOAT64, None), ("-Inf", Kind.FLOAT64, float("-inf")), ("2018-01-01", Kind.TIMESTAMP, None), ("x", Kind.JSON, "x")])
def test_parse(spark, text, kind, value):
    assert one(spark, parse_text(F.lit(text), kind)) == value


def test_parse_time(spark):
    assert one(spark, F.unix_seconds(parse_text(F.lit("1985-04-12T23:20:50.00Z"), Kind.TIMESTAMP))) == 482196050


def test_parse_numbers_against_python(spark):
    texts = ["0", "-0", "007", "1e5", "1.", ".5", ".", "e", "1e", "--1", "１", "1_000", "0x10", "2147483647", "2147483648", "-2147483648"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_int(F.col("t"), Kind.INT32).alias("i"), parse_float(F.col("t")).alias("f")).collect()
    for r in rows:
        whole = r.t.lstrip("+-").isascii() and r.t.removeprefix("-").isdigit() and r.t.isascii()
        assert r.i == (int(r.t) if whole and -(2**31) <= int(r.t) < 2**31 else None), r
        try:
            value = float(r.t) if "_" not in r.t and r.t.isascii() else None
        except ValueError:
            value = None
        assert r.f == value, r


@pytest.mark.parametrize("power", [0, 3, 6, 9])
def test_epoch_units(spark, power):
    assert one(spark, F.unix_seconds(from_epoch(F.lit(1514764800 * 10**power).cast("long")))) == datetime(2018, 1, 1, tzinfo=UTC).timestamp()
