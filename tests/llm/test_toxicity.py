"""Held-out accuracy, and the label model on votes that are known."""

from __future__ import annotations

import zlib

import numpy as np

from tidemark.llm import toxicity as tox


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = tox.op8_toxicity(spark, sf).collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(r.predicted and labels[r.doc_id] for r in held)
    assert hits / sum(r.predicted for r in held) > 0.75 and hits / sum(labels[r.doc_id] for r in held) > 0.8
    clean = [r for r in held if not labels[r.doc_id]]
    assert sum(r.predicted for r in clean) / len(clean) < 0.04


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "a fine day") for i in range(300)], "doc_id long, text string")
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)]
    true = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    wrong = spark.createDataFrame([(i, (i + out[i]) % 2) for i in range(300)], "doc_id long, toxic int")
    a, b = tox.train(docs, true), tox.train(docs, wrong)
    assert a.weights == b.weights and a.bias == b.bias


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "you idiot", 0.1), (2, "x " * 30000, 0.2), (2, "", 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    got = {(r.row.doc_id, r.row.text): r.score for r in tox.score_toxicity(docs, model).collect()}
    assert got[None, "you idiot"] > 0.7 and got[1, None] == got[2, ""] < 0.1
    assert tox.score_toxicity(docs.limit(0), model).count() == 0


def test_label_model():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    accuracy = (0.95, 0.9, 0.7, 0.65)
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y) * 2 - 1 for a in accuracy], 1)
    votes = np.concatenate([votes, votes[:, 3:], votes[:, 3:]], 1)  # two copies of the worst voter
    posterior, chances, correlation = tox.label_model(votes, np.where(votes[:, 0] > 0, 0.95, 0.05))
    assert ((posterior > 0.5) == y).mean() > 0.93
    assert correlation[3, 4] > 0.95 and abs(correlation[1, 2]) < 0.3
    right = [(chances[1][2][k] + chances[0][0][k]) / 2 for k in range(4)]
    assert right == sorted(right, reverse=True)


def test_label_model_against_its_definition():
    """One round without correlations, by sums over rows."""
    rng = np.random.default_rng(1)
    votes, start = rng.integers(-1, 2, (50, 4)), rng.random(50)
    posterior, chances, correlation = tox.label_model(votes, start, rounds=1)
    share = [1 / max(1.0, sum(max(0.0, min(1.0, c)) for c in row)) for row in correlation]
    prior = start.mean()
    for c, w in enumerate((1 - start, start)):
        for v in (-1, 0, 1):
            for k in range(4):
                assert np.isclose(chances[c][v + 1][k], (sum(w[r] for r in range(50) if votes[r, k] == v) + 0.5) / (w.sum() + 1.5))
    for r in range(50):
        logit = np.log(prior / (1 - prior)) + sum(share[k] * np.log(chances[1][votes[r, k] + 1][k] / chances[0][votes[r, k] + 1][k]) for k in range(4))
        assert np.isclose(posterior[r], 1 / (1 + np.exp(-logit)))


def test_lexicons_are_induced_on_other_rows():
    """A word that only one part's rows have votes for none of them, and a row's own label has no say in its votes."""
    rng = np.random.default_rng(4)
    ids, names = np.arange(200), np.arange(0, 40, 2)
    cols = rng.integers(1, 20, 600)
    rows = np.repeat(np.arange(200), 3)
    labels = rng.integers(0, 2, 200)
    own = np.flatnonzero(ids % tox.PARTS == 2)
    found = tox.lexicon_hits(labels, ids, names, np.append(rows, own), np.append(cols, np.zeros(len(own), int)))
    other = labels.copy()
    other[own] = 1 - other[own]
    again = tox.lexicon_hits(other, ids, names, np.append(rows, own), np.append(cols, np.zeros(len(own), int)))
    assert (found[own] == again[own]).all() and found.any()


def test_scores_are_the_sum_over_features():
    model = tox.Model({f: 0.1 * k for w in ("idiot", "moronic", "day") for k, f in enumerate(tox.features(w), 1)}, -1.0)
    texts = ["You idiot, idiots! Moronic day", "", "nothing here", "a day day daylong"]
    for text, got in zip(texts, tox.Scorer(model)(texts), strict=True):
        counts = {}
        for w in set(tox._WORD.findall(text.lower())):
            for f in tox.features(w):
                if f in model.weights:
                    counts[f] = counts.get(f, 0) + 1
        logit = -1 + sum(model.weights[f] * np.log2(1 + n) for f, n in counts.items())
        assert np.isclose(got, 1 / (1 + np.exp(-logit)))


def test_score_at_the_threshold_is_predicted(spark):
    """Ties at the threshold count as toxic; repeated rows have equal scores."""
    bias = float(np.log(0.7 / 0.3))
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "doc_id long, text string")
    rows = tox.score_toxicity(docs, tox.Model({}, bias + 1e-12)).collect()
    assert {r.score for r in rows} == {rows[0].score} and rows[0].score >= tox.THRESHOLD


def test_copies_train_once(spark):
    """A large group of copies of a toxic text doesn't make its plain words toxic."""
    rng = np.random.default_rng(9)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}o" for i in range(200)]
    texts = [" ".join(rng.choice(plain, 40)) + (" you idiot" if i % 8 == 0 else "") for i in range(800)]
    copied = " ".join(plain[:60]) + " moron"
    texts += [copied if i % 2 else copied.replace(plain[i % 60], "other") for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("idiot" in t or "moron" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    scores = {r.row.doc_id: r.score for r in tox.score_toxicity(docs, tox.train(docs, labels)).collect()}
    clean = [scores[i] >= 0.7 for i in range(800) if i % 8]
    assert sum(clean) / len(clean) < 0.02 and np.mean([scores[i] >= 0.7 for i in range(0, 800, 8)]) > 0.95
    found = [np.unique(np.array([f for w in set(t.split()) for f in tox.features(w)], "<u4")) for t in texts]
    assert len(tox.one_of_copies(found)) < 830
