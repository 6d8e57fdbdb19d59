"""Raking and sampling against numpy."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing


def rake(tokens, wants, sweeps=200):
    w = tokens.astype(float)
    for _ in range(sweeps):
        for axis, want in enumerate(wants):
            own = w.sum(tuple(a for a in range(3) if a != axis))
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * np.divide(want, own, out=np.zeros(len(want)), where=own > 0).reshape(shape)
    return w


def test_rake_against_numpy(spark):
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, (4, 3, 2))
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(tokens[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": 0.5, "lang": {"l0": 0.6, "l1": 0.3, "l2": 0.1}, "topic": 0.0}
    raked, off = mixing.rake(cells, targets)
    got = {(r.source, r.lang, r.topic): r.weight for r in raked.collect()}
    assert off < 1e-5
    total = tokens.sum()
    source = np.sqrt(tokens.sum((1, 2)))
    want = rake(tokens, [source / source.sum() * total, np.array([0.6, 0.3, 0.1]) * total, np.array([0.5, 0.5]) * total])
    for i, j, k in np.ndindex(4, 3, 2):
        assert got[f"s{i}", f"l{j}", f"t{k}"] == pytest.approx(want[i, j, k], rel=1e-4)


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.95])
def test_budget(spark, fraction):
    cells = spark.createDataFrame([("a", 100, 400.0), ("b", 1000, 500.0), ("c", 900, 1100.0), ("d", 0, 0.0)], "source string, tokens long, weight double")
    rows = mixing.calibrate(cells, fraction * 2000).collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    assert sum(r.probability * r.tokens for r in rows) == pytest.approx(fraction * 2000)
    free = [r for r in rows if 0 < r.probability < 1]
    assert len({round(r.probability * r.tokens / r.weight, 9) for r in free}) <= 1


def test_sample(spark):
    rows = [(i, "w " * (1 + i % 50), "big" if i % 3 else f"s{i % 5}", "en" if i % 2 else "fr") for i in range(6000)] + [(9000, None, None, None), (9001, "", "big", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix(df, mixing.TARGETS, 0.5).collect()
    assert len(out) == len(rows)
    tokens, chosen = defaultdict(float), defaultdict(float)
    for r in out:
        tokens[r.source] += r.n_tokens * r.probability
        chosen[r.source] += r.n_tokens * r.selected
    assert sum(tokens.values()) == pytest.approx(0.5 * sum(r.n_tokens for r in out), rel=1e-6)
    for s in tokens:
        assert chosen[s] == pytest.approx(tokens[s], rel=0.15, abs=50)
    again = {r.row.doc_id for r in mixing.mix(df.repartition(7), mixing.TARGETS, 0.5).collect() if r.selected}
    assert again == {r.row.doc_id for r in out if r.selected} and not again & {9000, 9001}
    assert mixing.mix(df.limit(0), mixing.TARGETS, 0.5).count() == 0


def test_words_and_forms(spark):
    from pyspark.sql import functions as F

    texts = ["", "a  b\tc\n", "AB CD EF", "12 345 678", "a\nb\nc\nd", "x " * 50, "x " * 500, "x " * 2000]
    got = [tuple(r) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(mixing.word_count(F.col("t")), mixing.form_topic(F.col("t"), mixing.word_count(F.col("t")))).collect()]
    assert got == [(0, "empty"), (3, "list"), (3, "shouting"), (3, "data"), (4, "list"), (50, "short prose"), (500, "prose"), (2000, "long prose")]


def words(text):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])


def topic(text):
    n, chars = words(text), max(1, len(text))
    if not n:
        return "empty"
    if sum("A" <= c <= "Z" for c in text) > 0.3 * chars:
        return "shouting"
    if sum("0" <= c <= "9" for c in text) > 0.1 * chars:
        return "data"
    if 8 * text.count("\n") > n:
        return "list"
    return "short prose" if n < 100 else "prose" if n < 1000 else "long prose"


@pytest.mark.parametrize("cells", [100_000, 0])
def test_query(spark, monkeypatch, cells):
    """Weights, chances and the choice of all documents, anew in numpy; raked on the driver and as tables."""
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", cells)
    sf = "/root/testdata/sf0.001" if not cells else "/root/testdata/sf0.01"
    rows = mixing.op1_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sums = defaultdict(int)
    for d in docs:
        sums[d.source or "", d.lang or "", topic(d.text or "")] += words(d.text)
    names = [sorted({k[i] for k in sums}) for i in range(3)]
    tokens = np.zeros([len(n) for n in names])
    for k, n in sums.items():
        tokens[tuple(names[i].index(k[i]) for i in range(3))] = n
    total, wants = tokens.sum(), []
    for axis, power in enumerate((0.5, 0.7, 0.5)):
        own = tokens.sum(tuple(a for a in range(3) if a != axis)) ** power
        wants.append(own / own.sum() * total)
    weight = rake(tokens, wants, 400)
    assert len(rows) == len(docs) and len({r.deviation for r in rows}) == 1
    scale = 0.5 * total / weight.sum()
    for _ in range(100):
        full = scale * weight >= tokens
        scale = (0.5 * total - tokens[full].sum()) / weight[~full].sum()
    for r in rows:
        at = tuple(names[i].index(r[d]) for i, d in enumerate(mixing.DIMENSIONS))
        assert r.weight == pytest.approx(weight[at] / tokens[at] if tokens[at] else 0, rel=0.02, abs=1e-6)
        assert r.probability == pytest.approx(min(1.0, scale * weight[at] / tokens[at]) if tokens[at] else 0, rel=0.02, abs=1e-6)
    assert sum(r.probability * r.n_tokens for r in rows) == pytest.approx(0.5 * total, rel=1e-6)
    assert 0 < sum(r.selected for r in rows) < len(rows)


def test_both_ways_agree(spark, monkeypatch):
    """Also where the targets contradict each other: the deviation says so."""
    rows = [(i, "w " * (i % 7), "a" if i % 3 else "b", "x" if i % 3 else "y") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.2, "y": 0.8}}
    out = []
    for cells in (100_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_CELLS", cells)
        out.append({r.row.doc_id: (round(r.weight, 9), round(r.probability, 9), r.selected, round(r.deviation, 9)) for r in mixing.mix(df, targets, 0.3).collect()})
    assert out[0] == out[1] and out[0][1][3] > 0.5


def test_awkward_rows(spark):
    """Repeated rows, columns with clashing names, a very long text."""
    rows = [(1, "a b", "s", "en", 5, "t"), (1, "a b", "s", "en", 5, "t"), (None, None, None, None, None, None), (2, "w " * 400_000, "s", "en", 1, "t"), (3, "", "s", "en", 1, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int, topic string")
    out = sorted(mixing.mix(df, mixing.TARGETS, 0.5).collect(), key=lambda r: (r.row.doc_id or 0))
    assert [r.n_tokens for r in out] == [0, 2, 2, 400_000, 0] and out[1] == out[2] and out[0].row.weight is None
