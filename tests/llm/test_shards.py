"""Shards: the law, the slots, and that groups keep together."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import shards


def check(rows, texts, n):
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = dict(texts)
    for r in rows:
        raw = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def together(rows, texts):
    """The share of linked documents that are where most of their group is."""
    where = {r.doc_id: r.shard for r in rows}
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(where[i])
    linked = [g for g in groups.values() if len(g) > 1]
    return sum(max(Counter(g).values()) for g in linked) / sum(map(len, linked))


@pytest.mark.parametrize(("hot", "n"), [(0, 8), (400, 8), (5, 40)])
def test_even_and_together(spark, hot, n):
    texts = [(i, f"text {i % 350}" if i < 700 else f"alone {i}") for i in range(1200)] + [(5000 + i, "hot") for i in range(hot)] + [(9000, None), (9001, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, shard int").repartition(3)
    rows = shards.assign_shards(df, n).collect()
    check(rows, texts, n)
    assert together(rows, [t for t in texts if t[1] != "hot"]) > 0.95
    hot_shards = Counter(r.shard for r in rows if r.doc_id in range(5000, 5000 + hot))
    assert hot < 10 or len(hot_shards) <= n


def test_a_hot_group_fills_few_shards(spark):
    n, hot = 40, 4000
    texts = [(i, f"text {i % 500}" if i < 1000 else f"alone {i}") for i in range(2 * hot)] + [(50_000 + i, "hot") for i in range(hot)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = shards.assign_shards(df, n).collect()
    check(rows, texts, n)
    assert together(rows, [t for t in texts if t[1] != "hot"]) > 0.95
    # a shard's share is three cells of the group or, as cells aren't split, two
    least = -(-hot * n // len(texts))
    assert least <= len({r.shard for r in rows if r.doc_id >= 50_000}) <= 1.5 * least


@pytest.mark.parametrize("buckets", [64, 1])
def test_no_move_is_left(spark, monkeypatch, buckets):
    """By brute force over all cells and shards: nothing that fits would gain votes, and no shard holds more than its share."""
    monkeypatch.setattr(shards, "MOVE_BUCKETS", buckets)
    r = random.Random(1)
    n, share = 6, 60
    cells = [(f"g{g}", first, first, r.randrange(1, 9)) for g in range(25) for first in r.sample(range(n), r.randrange(1, n))]
    load = Counter()
    cells = [c for c in cells if load[c[1]] + c[3] <= share and not load.update({c[1]: c[3]})]
    out = shards.propagate(spark.createDataFrame(cells, "group string, first int, shard int, n long"), share, n).collect()
    assert sorted((c.group, c.first, c.n) for c in out) == sorted((g, f, m) for g, f, _, m in cells)
    votes, load = Counter(), Counter()
    for c in out:
        votes[c.group, c.shard] += c.n
        load[c.shard] += c.n
    assert max(load.values()) <= share
    for c in out:
        assert not any(votes[c.group, s] > votes[c.group, c.shard] and load[s] + c.n <= share for s in range(n))
    kept, before = sum(v * v for v in votes.values()), Counter()
    for g, _, s, m in cells:
        before[g, s] += m
    assert kept > sum(v * v for v in before.values())


def test_cut_edges(spark):
    """Fewer than by hash alone; and the figure against brute force."""
    texts = [(i, f"text {i % 300}" if i < 900 else f"alone {i}") for i in range(2000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    placed = shards.assign_shards(df, 20)
    rows, text = placed.collect(), dict(texts)
    groups = defaultdict(list)
    for x in rows:
        groups[text[x.doc_id]].append(x.shard)
    pairs = [a != b for g in groups.values() for a, b in itertools.combinations(g, 2)]
    assert shards.cut_share(placed) == pytest.approx(sum(pairs) / len(pairs)) and sum(pairs) / len(pairs) < 0.1
    by_hash = placed.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(20)))
    assert shards.cut_share(by_hash) > 0.9


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "é" * 2_000_000), (2, "é" * 2_000_000), (3, None)], "doc_id long, text string")
    rows = shards.assign_shards(df, 2).collect()
    assert {r.doc_id: r.size for r in rows} == {1: 4_000_016, 2: 4_000_016, 3: 16}


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    rows = shards.assign_shards(df, 40).collect()
    assert len(rows) == 3 and len({(r.shard, r.slot) for r in rows}) == 3 and all(r.slot == 0 for r in rows)
    assert shards.assign_shards(df.limit(0), 40).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = shards.op10_shards(spark, sf).collect()
    check(rows, texts, 40)
    assert together(rows, texts) > 0.9 and {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
