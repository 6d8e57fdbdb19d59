"""Random checks of parsing, filters and merging."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.schema import Schema, schema_of
from tidemark.functions.types import CONVERTIBLE, Kind
from tidemark.functions.values import FALSE, TRUE, parse_bool, parse_int
from tidemark.operators.scan import parse_filters
from tidemark.operators.transform import backfill, merge

slow = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@slow
@given(st.lists(st.one_of(st.integers().map(str), st.text("0123456789+-. eE_x", max_size=22), st.sampled_from([*TRUE, *FALSE, "yes"])), min_size=1, max_size=30))
def test_strict_numbers(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_int(F.col("t"), Kind.INT64).alias("i"), parse_bool(F.col("t")).alias("b")).collect()
    for r in rows:
        digits = r.t[1:] if r.t[:1] in ("+", "-") else r.t
        value = int(r.t) if digits.isascii() and digits.isdigit() else None
        assert r.i == (value if value is not None and -(2**63) <= value < 2**63 else None)
        assert r.b == (True if r.t in TRUE else False if r.t in FALSE else None)


@given(st.text(max_size=20), st.integers(0, 2**40), st.integers(0, 2**40))
def test_filters_keep_their_values(value, low, high):
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    d = parse_filters([f"h == '{quoted}'", f"s>={low}&&s<{high}"], "h", "s")
    assert d.hashes == [value] and d.ranges == [(low, high)]


kinds = st.dictionaries(st.sampled_from(["a", "b", "c"]), st.sampled_from([Kind.INT32, Kind.STRING, Kind.JSON, Kind.BOOL]), min_size=1)


@slow
@given(st.lists(kinds, min_size=1, max_size=3))
def test_merge_has_every_row_and_column(spark, schemas):
    frames = [spark.range(i + 1).select(*(F.lit("1").cast(k.spark).alias(c, metadata={"kind": k.name}) for c, k in s.items())) for i, s in enumerate(schemas)]
    out = merge(frames)
    want = Schema()
    for s in schemas:
        want = Schema({**s, **want})
    assert schema_of(out.schema) == want and out.count() == sum(range(1, len(schemas) + 1))
    for c, k in want.items():
        assert out.where(F.col(c).isNotNull()).count() == sum(i + 1 for i, s in enumerate(schemas) if s.get(c) is k)


@given(kinds, st.sampled_from("abc"), st.sampled_from(list(Kind)))
def test_targets(schema, column, kind):
    target = Schema(schema).target_of(column, kind)
    assert target == (schema[column] if column in schema and schema[column] in CONVERTIBLE[kind] else None)


def test_backfill_order(spark):
    assert backfill(spark.range(1), Schema({"z": Kind.INT32, "id": Kind.INT64})).columns == ["id", "z"]
