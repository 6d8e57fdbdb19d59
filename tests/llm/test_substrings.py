"""Substring dedup against brute force, in small and awkward settings."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import fm_index, substrings

W = substrings.WINDOW


def brute(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + W]) for w in words for i in range(len(w) - W + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - W + 1):
            if seen[tuple(w[i : i + W])] > 1:
                keep[i : i + W] = [False] * W
        out.append((len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return out


def corpus():
    r = random.Random(5)
    word = lambda n=400: f"w{r.randrange(n)}"
    passages = [[word() for _ in range(r.randrange(30, 90))] for _ in range(4)]
    texts = [None, "", "  ", "one two", "the " * 34, "the " * 35, "the " * 80, "a b c " * 40, "\x1c\x1d\x85 x" * 60]
    for _ in range(60):
        words = [word() for _ in range(r.randrange(0, 150))]
        for p in passages:
            if r.random() < 0.3:
                at = r.randrange(len(words) + 1)
                cut = r.randrange(0, 10)
                words[at:at] = p[cut:]
        texts.append(" ".join(words))
    texts += [texts[20], texts[20], texts[21] + " tail", "\n".join(texts[22].split())]
    return texts


@pytest.mark.parametrize(("hot", "shard", "lane"), [(10_000, 1_000_000, 32), (1, 1_000_000, 32), (10_000, 200, 3)])
def test_against_brute_force(spark, monkeypatch, hot, shard, lane):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.drop_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert sum(b[1] for b in brute(texts)) > 500


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (None, "x " + text), (2, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 51, 50), (1, 50, 50), (1, 50, 50), (2, 0, 0)]
    assert substrings.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_counts():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(1, 4, 500), [0]])
    index = fm_index.FMIndex(text, 4)
    s = text.tobytes()
    for n in (1, 2, 3, 5, 8):
        for start in range(0, 480, 37):
            p = text[start : start + n]
            low, high = index.one(p[-1:])
            for x in p[-2::-1]:
                low, high = index.extend(np.array([x]), low, high)
            assert high[0] - low[0] == sum((text[i : i + n] == p).all() for i in range(501 - n)), (n, start, s[:4])


@pytest.mark.parametrize("window", [2, 5, 9])
def test_windows(window):
    rng = np.random.default_rng(window)
    text = np.concatenate([rng.integers(1, 5, 300), [0], rng.integers(1, 3, 100), [0]])
    index = fm_index.FMIndex(text, 5)
    begin, end = np.array([0, 150, 301]), np.array([150 + window - 1, 300, 401])
    seen = Counter(tuple(text[i : i + window]) for i in range(len(text) - window + 1))
    want = [i for a, b in zip(begin, end, strict=True) for i in range(a, b - window + 1) if seen[tuple(text[i : i + window])] > 1]
    assert fm_index.repeated_windows(index, text, begin, end, window).tolist() == sorted(want)


def test_a_very_long_text(spark):
    """A text of 300,000 words that repeats a passage of its own, and shares another with a short one."""
    words = [f"w{i}" for i in range(300_000)]
    words[200_000:200_050] = words[100:150]
    short = ["x", *words[5_000:5_040], "y"]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(short))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.drop_repeats(df).collect()}
    kept = [w for i, w in enumerate(words) if not (100 <= i < 150 or 200_000 <= i < 200_050 or 5_000 <= i < 5_040)]
    assert got[1] == (300_000, 140, " ".join(kept)) and got[2] == (42, 40, "x y")


def test_many_repeated_rows(spark):
    """Rows with equal ids and texts stand in the index once, and all lose the same words."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text)] * 300 + [(2, f"x {text} y"), (3, "alone")], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, r.kept) for r in substrings.drop_repeats(df).collect()}
    assert got == {(1, 60, ""), (2, 60, "x y"), (3, 0, "alone")}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_occurs(least):
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = fm_index.FMIndex(text, 4)
    begin = rng.integers(0, 290, 200)
    end = np.minimum(begin + rng.integers(1, 12, 200), 300)
    found = fm_index.occurs(index, text, begin, end, least)
    raw = [tuple(text[i:]) for i in range(300)]
    want = [sum(r[: e - b] == tuple(text[b:e]) for r in raw) >= least for b, e in zip(begin, end, strict=True)]
    assert found.tolist() == want and (sum(want) < 200 or least == 1)
