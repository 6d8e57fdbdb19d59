"""Joins over time against plain loops."""

from __future__ import annotations

import random

import pytest

from tidemark.operators.joins import asof_join, interval_join


def rows(r, n, keys):
    return [(i, r.choice([*keys, None]), r.choice([None, *range(0, 400_000, 1777)])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, k string, s long").selectExpr("id", "k", "timestamp_seconds(s) as t")


@pytest.mark.parametrize("slice_seconds", [86_400, 3_600, 10_000_000])
def test_asof(spark, slice_seconds):
    r = random.Random(1)
    left, right = rows(r, 120, "ab"), rows(r, 60, "abc")
    got = {x.id: x.last_id for x in asof_join(frame(spark, left), frame(spark, right), "t", "k", "id", slice_seconds=slice_seconds).collect()}
    want = {}
    for i, k, s in left:
        fits = [(s2, j) for j, k2, s2 in right if k is not None and k2 == k and s is not None and s2 is not None and s2 <= s]
        want[i] = max(fits)[1] if fits else None
    assert got == want and any(v is not None for v in got.values())


@pytest.mark.parametrize(("before", "after"), [(0, 0), (5_000, 0), (20_000, 90_000)])
def test_interval(spark, before, after):
    r = random.Random(2)
    left, right = rows(r, 80, "ab"), rows(r, 80, "abc")
    got = sorted((x.id, x.near_id) for x in interval_join(frame(spark, left), frame(spark, right), "t", "k", before, after).collect())
    assert got == sorted((i, j) for i, k, s in left for j, k2, s2 in right if k is not None and k2 == k and s is not None and s2 is not None and -before <= s2 - s <= after)


def test_hot_key(spark):
    """A key with nearly all rows is dealt over many slices."""
    left = spark.range(5_000).selectExpr("id", "'hot' as k", "timestamp_seconds(id * 600) as t")
    out = asof_join(left, left.where("id % 7 = 0"), "t", "k", "id")
    assert out.where("last_id != id - id % 7").count() == 0 and out.count() == 5_000


def test_no_rows(spark):
    empty = frame(spark, [])
    assert asof_join(empty, empty, "t", "k").count() == 0 and interval_join(empty, empty, "t", "k", 1, 1).count() == 0
    assert asof_join(frame(spark, [(1, "a", 5)]), empty, "t", "k").collect()[0].last_id is None
