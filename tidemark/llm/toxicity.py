"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters are lexicons (a short seed list in parts; lists of words and of word beginnings that tell the labels of the training rows apart, each
feature in one list, and a row's votes by lists induced on other rows) and patterns (shouting, exclamation marks, repeated words, several
lexicons at once). Each votes toxic, votes clean or abstains. The label model knows the votes alone, no labels: from the lexicons' majority on,
it estimates by expectation-maximisation the chances of every vote in either class, finds the correlations that are left between voters within
a class, and lets correlated voters share their weight. The classifier is a logistic regression on hashed words and word beginnings (in how many
different words each occurs), trained on the model's posterior labels; features that don't tell the classes apart get no weight.

Near copies among the training rows train once. Labels are read only from rows of the training fold, at most about SAMPLE of them (chosen by a hash of the id); the score
of a text depends on the text alone. A null text counts as empty and has no features, so its score is the classifier's
bias. Rows with a null label or id train nothing. Without any training row the seed words alone have weight. Repeated rows
each give a row. Other columns are ignored, whatever their names.
"""

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import few, kept, map_arrow, release, small_batches, table, text_of
from tidemark.llm.words import mix

#: Common insults, in the parts that vote separately.
SEEDS = ("idiot moron stupid imbecile dumb".split(), "scum trash worthless garbage vermin".split(), "loser pathetic disgusting clown hate".split())
#: Labelled rows that train at most, on average.
SAMPLE = 6_000
#: Entries of the training matrix handled at a time.
PART = 500_000
#: Bits of a feature's hash; lengths of word beginnings that are features.
BITS, STARTS = 22, (3, 4, 5, 6, 7)
#: Documents in the sample in which a feature occurs at least.
LEAST = 4
#: Parts of the training rows (a part votes by lexicons induced on the others), lexicons of words and as many of word beginnings.
PARTS, LEXICONS = 5, 3
#: Share of toxic rows among a lexicon feature's rows, shrunk by so many rows of the usual share, and toxic rows with it, at least.
PURITY, SHRINK, LEAST_TOXIC = 0.5, 5, 2
#: Least hashes by which near copies among the training rows are told, and how many of them are equal at least.
SKETCH, ALIKE = 6, 5
#: Chi-square that a feature's split of the posterior labels reaches at least.
TELLING = 25.0
THRESHOLD = 0.7
#: Words kept in a worker's cache.
CACHE_WORDS = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column) -> Column:
    """The fold kept away from training, by the id alone."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(word: str) -> list[int]:
    """Hashes of the word (even) and of its beginnings (odd)."""
    mask = (1 << BITS) - 2
    return [zlib.crc32(word.encode()) & mask, *(zlib.crc32(word[:n].encode()) & mask | 1 for n in STARTS if len(word) > n)]


def seed_features(part: int) -> list[int]:
    return [features(w)[0] for w in SEEDS[part]]


def pattern_votes(text: str, words: list[str]) -> list[int]:
    """1 toxic, -1 clean, 0 abstains: capitals, exclamation marks, few different words."""
    letters = sum(map(len, words)) or 1
    capitals = sum(1 for c in text if c.isupper())
    return [int(capitals > 0.5 * letters), int(text.count("!") > 0.05 * (len(words) or 1)), int(len(words) > 50 and len(set(words)) < 0.2 * len(words))]


@dataclass
class Model:
    """Weights by feature, and the bias; accuracies and correlations of the voters for reports."""

    weights: dict[int, float]
    bias: float
    accuracy: np.ndarray | None = None
    correlation: np.ndarray | None = None


def default_model() -> Model:
    return Model({f: 6.0 for part in range(len(SEEDS)) for f in seed_features(part)}, -3.0)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior chance of toxic for each row of votes (-1, 0, 1); chances of each vote by class; correlations.

    start: first guess of the posterior. Correlated voters' log odds are divided by how many they amount to."""
    n, m = votes.shape
    shown = np.stack([(votes == v).astype(np.float64) for v in (-1, 0, 1)])  # vote, row, voter
    posterior, share, correlation = start.copy(), np.ones(m), np.eye(m)
    chances = np.zeros((2, 3, m))
    for i in range(rounds):
        for c, w in enumerate((1 - posterior, posterior)):
            chances[c] = (np.einsum("r,vrm->vm", w, shown) + 0.5) / (w.sum() + 1.5)
        prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        if i % 5 == 0:  # what is common to two voters beyond the class; from the start, lest copies outvote the rest
            rest = np.zeros((m, m))
            for c, w in enumerate((1 - posterior, posterior)):
                x = votes - (chances[c][2] - chances[c][0])
                rest += (x * w[:, None]).T @ x
            spread = np.sqrt(np.maximum(np.diag(rest), 1e-9))
            correlation = rest / np.outer(spread, spread)
            np.fill_diagonal(correlation, 1.0)
            share = 1 / np.maximum(1.0, np.clip(correlation, 0, 1).sum(1))
        odds = np.log(chances[1]) - np.log(chances[0])
        logit = np.log(prior / (1 - prior)) + np.einsum("vm,vrm->r", odds * share, shown)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, chances, correlation


def _telling(rows: np.ndarray, cols: np.ndarray, n_cols: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chi-square and log odds of each feature against soft labels."""
    n, on = len(y), y.sum()
    df, hits = np.zeros(n_cols), np.zeros(n_cols)
    for i in range(0, len(rows), PART):
        df += np.bincount(cols[i : i + PART], minlength=n_cols)
        hits += np.bincount(cols[i : i + PART], weights=y[rows[i : i + PART]], minlength=n_cols)
    expected = df * on / n
    chi = (hits - expected) ** 2 / np.maximum(expected * (1 - on / n) * (1 - df / n), 1e-9)
    odds = np.log((hits + 0.5) / (on + 1)) - np.log((df - hits + 0.5) / (n - on + 1))
    return chi, odds


def lexicon_hits(labels: np.ndarray, ids: np.ndarray, names: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Whether each row has a feature of each lexicon, induced on the parts that the row isn't in. names: the features' hashes."""
    out, n = np.zeros((len(labels), 2 * LEXICONS), bool), len(names)
    lexicon, own = names % 2 * LEXICONS + (names >> 1) % LEXICONS, ids % PARTS
    df, toxic = np.zeros(PARTS * n), np.zeros(PARTS * n)
    for i in range(0, len(rows), PART):  # by part and feature
        r = rows[i : i + PART]
        at = own[r] * n + cols[i : i + PART]
        df += np.bincount(at, minlength=PARTS * n)
        toxic += np.bincount(at, weights=labels[r], minlength=PARTS * n)
    df, toxic = (x.reshape(PARTS, n) for x in (df, toxic))
    others = [labels[own != part] for part in range(PARTS)]
    share = np.array([x.mean() if len(x) else 0.0 for x in others])[:, None]
    df, toxic = df.sum(0) - df, toxic.sum(0) - toxic
    good = ((toxic + SHRINK * share) / (df + SHRINK) >= PURITY) & (toxic >= LEAST_TOXIC)
    for i in range(0, len(rows), PART):
        r, c = rows[i : i + PART], cols[i : i + PART]
        telling = good[own[r], c]
        out[r[telling], lexicon[c[telling]]] = True
    return out


def one_of_copies(found: list[np.ndarray]) -> np.ndarray:
    """Rows of which no earlier row kept is a near copy, told by equal least hashes of the features: else what all copies of a text have would
    pass for what its label has."""
    random = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    chosen, seen = [], {}
    for row, own in enumerate(found):
        if not len(own):
            chosen.append(row)
            continue
        keys = [(k, int(mix(own.astype(np.uint64) ^ r).min())) for k, r in enumerate(random)]
        if max(Counter(i for key in keys for i in seen.get(key, ())).values(), default=0) < ALIKE:
            chosen.append(row)
            for key in keys:
                seen.setdefault(key, []).append(row)
    return np.array(chosen, np.int64)


def fit(labels: np.ndarray, ids: np.ndarray, found: list[np.ndarray], times: list[np.ndarray], patterns: np.ndarray) -> Model:
    """labels, a hash of ids, features, in how many words each is, and pattern votes of the training rows -> the model."""
    use = one_of_copies(found)
    labels, ids, patterns = labels[use], ids[use], patterns[use]
    found, times = [found[i] for i in use], [times[i] for i in use]
    n = len(labels)
    if n < 20 or labels.min() == labels.max():
        return default_model()
    seeds = [seed_features(part) for part in range(len(SEEDS))]
    counts = np.zeros(1 << BITS, np.int32)
    for own in found:
        counts[own] += 1
    keep = counts >= min(LEAST, max(1, n // 50))
    keep[np.concatenate(seeds)] |= counts[np.concatenate(seeds)] > 0
    names = np.flatnonzero(keep)
    place = np.full(1 << BITS, -1, np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    chosen = [keep[own] for own in found]
    rows = np.repeat(np.arange(n, dtype=np.int32), [int(c.sum()) for c in chosen])
    cols = np.concatenate([place[own[c]] for own, c in zip(found, chosen, strict=True)])
    value = np.concatenate([own[c] for own, c in zip(times, chosen, strict=True)])  # bytes; logarithms are for the features in use
    del chosen, place, counts
    lists = lexicon_hits(labels, ids, names, rows, cols)
    hits = np.zeros((n, len(seeds)), bool)
    for k, own in enumerate(seeds):
        hits[rows[np.isin(names, own)[cols]], k] = True
    hits = np.concatenate([hits, lists], 1)
    several = hits.sum(1)
    votes = np.concatenate([np.where(hits, 1, 0), np.where(several[:, None] >= 2, 1, np.where(several[:, None] == 0, -1, 0)), patterns], 1)
    posterior, chances, correlation = label_model(votes, np.where(several >= 2, 0.9, np.where(several == 1, 0.3, 0.03)))
    # the linear classifier
    chi, _ = _telling(rows, cols, len(names), posterior)
    use = chi >= TELLING
    if not use.any():
        return default_model()
    at = np.cumsum(use) - 1
    r, x, c = rows[use[cols]], np.log2(1 + value[use[cols]].astype(np.float64)), at[cols[use[cols]]]
    w, bias, m = np.zeros(int(use.sum())), float(np.log(posterior.mean() / (1 - posterior.mean()))), np.zeros(int(use.sum()) + 1)
    v = np.zeros(len(m))
    for step in range(1, 301):  # Adam on the mean log loss, a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(r, weights=w[c] * x, minlength=n), -30, 30)))
        error = (p - posterior) / n
        gradient = np.append(np.bincount(c, weights=error[r] * x, minlength=len(w)) + 1e-5 * w, error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(dict(zip(names[use].tolist(), w.tolist(), strict=True)), float(bias), chances, correlation)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model from the training fold's labelled rows."""
    ids = F.col(id_col)
    fold = labels.where(ids.isNotNull() & F.col(label_col).isNotNull() & ~held_out(ids)).select(ids.alias("label_id"), F.col(label_col).cast("int").alias("label")).distinct()
    n = fold.count()
    if not n:
        return default_model()
    if n > sample:
        fold = fold.where(F.pmod(F.xxhash64(F.lit(8), "label_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    joined = docs.select(ids.alias("label_id"), text_of(text_col).alias("text")).join(F.broadcast(fold), "label_id").select("label_id", "label", "text")  # the fold has about SAMPLE rows at most

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, times, patterns = [], [], []
        for text in batch.column("text").to_pylist():
            words = _WORD.findall(text.lower())
            found, n = np.unique(np.array([f for w in set(words) for f in features(w)], "<u4"), return_counts=True)
            own.append(found.tobytes())
            times.append(np.minimum(n, 255).astype(np.uint8).tobytes())
            patterns.append(pattern_votes(text, words))
        hashes = [zlib.crc32(str(i).encode()) // 3 for i in batch.column("label_id").to_pylist()]
        return pa.record_batch([pa.array(hashes, pa.int64()), batch.column("label"), pa.array(own, pa.binary()), pa.array(times, pa.binary()), pa.array(patterns, pa.list_(pa.int32()))], names=["h", "label", "own", "times", "patterns"])

    got = sorted((r["h"], r["label"], bytes(r["own"]), bytes(r["times"]), tuple(r["patterns"])) for r in map_arrow(joined, extract, "h long, label int, own binary, times binary, patterns array<int>").collect())  # about SAMPLE rows
    if not got:
        return default_model()
    model = fit(np.array([g[1] for g in got]), np.array([g[0] for g in got]), [np.frombuffer(g[2], "<u4") for g in got], [np.frombuffer(g[3], np.uint8) for g in got], np.array([g[4] for g in got]))
    del got
    release()
    return model


class Scorer:
    """Scores of texts, a batch at a time; only words that the model has weights for are looked at one by one."""

    def __init__(self, model: Model):
        self.model = model
        self.place = {f: i for i, f in enumerate(model.weights)}
        self.weights = np.fromiter(model.weights.values(), np.float64, len(model.weights))
        self.seen: set[str] = set()
        self.telling: dict[str, list[int]] = {}

    def __call__(self, texts: Iterable[str]) -> np.ndarray:
        place, hits, owner, n = self.place, [], [], 0
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
            self.telling.clear()
        for n, text in enumerate(texts, 1):
            words = set(_WORD.findall(text.lower()))
            new = words - self.seen
            for w in new:
                own = [place[f] for f in features(w) if f in place]
                if own:
                    self.telling[w] = own
            self.seen |= new
            found = [f for w in self.telling.keys() & words for f in self.telling[w]]
            hits += found
            owner += [n - 1] * len(found)
        width = max(1, len(place))
        pairs, counts = np.unique(np.array(owner, np.int64) * width + np.array(hits, np.int64), return_counts=True)
        logit = self.model.bias + np.bincount(pairs // width, np.log2(1 + counts) * self.weights[pairs % width], n) if len(pairs) else np.full(n, self.model.bias)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of docs in a struct named row, with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each telling feature of the sample
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(kept(key, lambda: Scorer(shared.value))(texts))
        release()

    small_batches(docs.sparkSession)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), score(text_of(text_col)).alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = few(table(spark, sf_dir, "documents")).select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
