"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tidemark.llm import ngram_join as nj


def gram_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts):
    sets = [gram_set(t) for t in texts]
    links = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(texts))]
    return [(root[i], len(links[i])) for i in range(len(texts))]


def corpus():
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(3000)}" for _ in range(120)) for _ in range(12)]
    texts = [None, "", "", " \n", "one two", "one  two", "one two three", "a b c d e", "a b c d e"]
    for b in base:
        texts.append(b)
        for _ in range(r.randrange(6)):
            words = b.split()
            for _ in range(r.randrange(0, 5)):
                words[r.randrange(len(words))] = f"x{r.randrange(99)}"
            texts.append(" ".join(words))
    hub = [f"h{i}" for i in range(150)]
    for _ in range(40):
        words = list(hub)
        for _ in range(2):
            words[r.randrange(len(words))] = f"x{r.randrange(999)}"
        texts.append(" ".join(words))
    return texts + [texts[9], texts[9]]


@pytest.mark.parametrize("block", [512, 7])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pivot int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.ngram_join(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in nj.ngram_join(df).collect()) == [(3, 3, 2), (5, 3, 2), (5, 3, 2)]
    assert nj.ngram_join(df.limit(0)).count() == 0


def test_ids_do_not_key_classes(spark):
    """One id with other texts, and rows without an id, lose no link."""
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    got = nj.ngram_join(spark.createDataFrame([(1, a), (1, b), (2, a + " tail"), (3, b + " tail")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    got = nj.ngram_join(spark.createDataFrame([(None, a), (2, a + " tail"), (3, a + " tail")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.n_links) for r in got) == [(0, 2, 2), (2, 2, 2), (3, 2, 2)]


@pytest.mark.parametrize("grams", [500_000, 400])
def test_random_ids(spark, monkeypatch, grams):
    monkeypatch.setattr(nj, "BLOCK_GRAMS", grams)
    r, texts = random.Random(5), corpus()
    ids = [r.choice([None, *range(25)]) for _ in texts]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    found = brute(texts)
    least = {}
    for i, (root, _) in zip(ids, found, strict=True):
        least.setdefault(root, []).append(i)
    least = {root: min((i for i in own if i is not None), default=None) for root, own in least.items()}
    want = [(i, least[root] if grams_of else i, n) for i, grams_of, (root, n) in zip(ids, map(gram_set, texts), found, strict=True)]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(map(tuple, nj.ngram_join(df).collect()), key=key) == sorted(want, key=key)
    kept = [(x.doc_id, x.text) for x in nj.one_of_each(df).collect()]
    worded = [(root, i, t) for (root, _), i, t in zip(found, ids, texts, strict=True) if gram_set(t)]
    assert len(kept) == len({root for root, _, _ in worded}) + sum(not gram_set(t) for t in texts)
    roots = {}
    for root, i, t in worded:
        roots.setdefault((i, t), root)
    heads = [(i, t) for i, t in kept if gram_set(t)]
    assert len({roots[h] for h in heads}) == len(heads) and all(i == least[roots[i, t]] for i, t in heads)


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "w0 w1 w2 w3 w4 w5")], "doc_id long, text string")
    assert sorted(tuple(r) for r in nj.ngram_join(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_bands():
    b = nj.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**4) ** b >= 0.9999 > 1 - (1 - 0.8**4) ** (b - 1)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(nj, "COLUMNS", 3)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, n)).astype(np.uint64) for n in (0, 5, 20, 30)]
    assert nj.shared_counts(sets, sets).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
