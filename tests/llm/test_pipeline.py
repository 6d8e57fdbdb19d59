"""The pipeline's stages, one by one, against what the operators and brute force say."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tests.llm.test_ngram_join import brute
    from tests.llm.test_pii import base

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames, counts = [docs], [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
        counts.append(frames[-1].count())
        assert k == 4 or frames[-1].columns == docs.columns
    read = [{r.doc_id: r for r in f.collect()} for f in frames]
    assert len(read[1]) > 0.8 * len(read[0]) and not any(w in read[1][i].text.lower().split() for i in read[1] for w in ("idiot", "moron"))
    ids = sorted(read[1])
    groups = brute([read[1][i].text for i in ids])
    assert set(read[2]) == {ids[g] for g, _ in groups} and len(read[2]) < len(read[1])
    assert set(read[3]) == set(read[2]) and not any(base(r.text) for r in read[3].values())
    assert all(read[3][i].text == read[2][i].text for i in read[3] if not base(read[2][i].text))
    assert 0 < len(read[4]) < len(read[3]) and set(read[4]) <= set(read[3])
    assert set(read[5]) == set(read[4]) and all(len(r.ids) == 4 * r.n_tokens for r in read[5].values())
    again = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert again == {i: r.ids_sha256 for i, r in read[5].items()}


def test_awkward_rows(spark, tmp_path):
    rows = [(1, "a b c d e f", None, None, 11), (1, "a b c d e f", None, None, 11), (2, None, "en", "s", None), (None, "x", None, "s", 1), (None, "x", None, "s", 1), (4, "", "en", "s", 0), (5, "w " * 300_000, "en", "s", 600_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 5]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_id_with_several_texts(spark):
    """A text of its own stays, even if its id also names a copy of another document."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(2, a + " tail"), (2, b), (1, a), (3, b + " tail")], "doc_id long, text string")
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert sorted(map(tuple, kept.collect())) == [(1, a), (2, b)]


def test_columns_with_clashing_names(spark):
    names = ["row", "id", "th", "head", "score", "found", "piece", "spans", "key", "worded", "selected"]
    docs = spark.createDataFrame([(i, f"write to user{i}@mail.com {i}", "en", "s", 30, *range(len(names))) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(r[5:] == tuple(range(len(names))) for r in out.collect())
    assert corpus_pipeline.tokens(spark, docs, SF).count() == 20
