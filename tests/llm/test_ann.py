"""The inverted multi-index against all inner products."""

from __future__ import annotations

import heapq

import numpy as np
import pytest

from tidemark.llm import ann


def exact(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            scores = sorted(((-float((v * q).sum()), j) for j, v in zip(ids, x, strict=True) if j != i))
            out[i] = [j for _, j in scores[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in rows], "vec_id long, embedding array<float>, score int")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.get(r.query_id, [])) + 1
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "TRIED", 20)
    monkeypatch.setattr(ann, "BLOCK", 300)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16)).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32).astype(np.float64)
    got = found(ann.search(frame(spark, enumerate(x)), every=40))
    want = exact(range(2000), x, 40, 20)
    recall = np.mean([len({v for v, _ in got[q]} & set(w)) / 20 for q, w in want.items()])
    assert got.keys() == want.keys() and recall >= 0.9
    for q, own in got.items():
        assert all(abs(s - float((x[q] * x[v]).sum())) < 1e-12 for v, s in own) and len(own) == 20


def test_ties_and_invalid_vectors(spark):
    same = [1.0, 0.5, 0.0]
    rows = [(i, same) for i in range(60)] + [(100, None), (101, [0, 0, 0]), (102, [1, None, 1]), (103, [1, float("nan"), 1]), (104, [1.0, 2.0]), (105, [float("inf"), 1, 1])]
    got = found(ann.search(frame(spark, rows), every=20))
    assert {q: [v for v, _ in own] for q, own in got.items()} == {q: [v for v in range(22) if v != q][:20] for q in (0, 20, 40)}


def test_query(spark):
    """The query's recall against all inner products, and its scores in double precision."""
    sf = "/root/testdata/sf0.1"
    data = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = found(ann.op4_ann(spark, sf))
    want = exact(list(data), list(data.values()), 20, 20)
    assert got.keys() == want.keys() and all(len(own) == 20 for own in got.values())
    assert np.mean([len({v for v, _ in got[q]} & set(w)) / 20 for q, w in want.items()]) >= 0.9
    for q, own in got.items():
        assert all(abs(s - float((data[q] * data[v]).sum())) < 1e-12 for v, s in own) and [s for _, s in own] == sorted((s for _, s in own), reverse=True)


def test_repeated_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)).astype(np.float32).astype(np.float64)
    rows = [*enumerate(x), (0, x[0]), (0, x[0]), (7, x[7]), (20, x[33])]
    x[20] = min(x[20], x[33], key=lambda v: v.astype("<f4").tobytes())
    got = found(ann.search(frame(spark, rows), every=20))
    want = exact(range(60), x, 20, 20)
    assert all(len({v for v, _ in own}) == len(own) == 20 for own in got.values()) and got.keys() == want.keys()
    assert np.mean([len({v for v, _ in own} & set(want[q])) / 20 for q, own in got.items()]) >= 0.9


def test_structured_vectors_are_not_all_visited(spark, monkeypatch):
    visited = []
    traverse = ann.traverse
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))).astype(np.float32).astype(np.float64)
    books = [ann.k_means(x[:, :8], 32), ann.k_means(x[:, 8:], 32)]
    a, b = ann.nearest(x[:, :8], books[0]), ann.nearest(x[:, 8:], books[1])
    counts = np.zeros((32, 32), np.int64)
    np.add.at(counts, (a, b), 1)
    near = exact(range(3000), x, 300, 20)
    seen = np.concatenate([ann.position(books[0] @ x[q, :8], books[1] @ x[q, 8:], counts, a[own] * 32 + b[own]) for q, own in near.items()])
    wanted = float(np.quantile(seen, 0.94, method="higher"))
    assert wanted < 0.25 * 3000
    for q, own in near.items():  # what position() says is what the heap does
        cells = traverse(books[0] @ x[q, :8], books[1] @ x[q, 8:], counts, wanted)
        visited.append(sum((a[v], b[v]) in set(cells) for v in own) / 20)
    assert np.mean(visited) >= 0.93


def test_few_and_none(spark):
    got = found(ann.search(frame(spark, [(0, [1, 0]), (3, [0, 1]), (5, [-1, 0])]), every=20))
    assert got == {0: [(3, 0.0), (5, -1.0)]}
    assert ann.search(frame(spark, [(1, None)]), every=20).count() == 0
    assert ann.search(frame(spark, [(1, [1.0])]).limit(0), every=20).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_traversal_order(seed):
    rng = np.random.default_rng(seed)
    first, second = rng.normal(size=7), rng.normal(size=9)
    counts = rng.integers(0, 3, (7, 9))
    cells = ann.traverse(first, second, counts, counts.sum())
    want = heapq.nlargest(63, ((first[i] + second[j], i, j) for i in range(7) for j in range(9) if counts[i, j]))
    assert cells == [(i, j) for _, i, j in want]
    some = ann.traverse(first, second, counts, 10)
    assert some == cells[: len(some)] and sum(counts[c] for c in some) >= 10 > sum(counts[c] for c in some[:-1])
