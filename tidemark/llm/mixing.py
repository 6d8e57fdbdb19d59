"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens (words between white space) are summed by source, language and topic; the cells' weights are raked to the target
marginals of the three in turn until all agree, or come no closer (targets can contradict each other or the empty cells); what is left is
reported as the deviation: tokens in the wrong place, as a share of all, summed over the three. A document's chance is its cell's weight per
token, scaled so that the chosen tokens meet the budget; where a chance would exceed 1 it is 1, and the rest is scaled up for it.

Up to BROADCAST_CELLS cells are raked as arrays on the driver and broadcast to the documents; more are raked and joined as tables.
Both ways do the same sweeps.

A null source, language or topic is a value of its own (the empty string). A null text counts as empty. Cells without
tokens get no weight, so their documents are never drawn. Equal ids are drawn alike. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, few, table, text_of

#: Cells up to which they are raked on the driver and broadcast to the documents (some 10 MB).
BROADCAST_CELLS = 100_000
#: Sweeps over the three marginals between two checks, the deviation that is good enough, and what it falls by at least between
#: two checks while sweeping goes on.
SWEEPS, CLOSE, FALL = 4, 1e-7, 1e-3
DIMENSIONS = ("source", "lang", "topic")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def form_topic(text: Column, words: Column) -> Column:
    """A topic by form, for tables that have none: shouting, data, lists, or prose by length."""
    chars = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(words == 0, "empty")
        .when(F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 0.3 * chars, "shouting")
        .when(F.length(F.regexp_replace(text, "[^0-9]+", "")) > 0.1 * chars, "data")
        .when(F.regexp_count(text, F.lit("\n")) * 8 > words, "list")
        .when(words < 100, "short prose")
        .when(words < 1000, "prose")
        .otherwise("long prose")
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target tokens of each value: its tokens to a power, scaled to the same total."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").alias("own"))
    total, scale = own.agg(F.sum("own"), F.sum(F.pow("own", F.lit(power)))).first()
    return own.select(dimension, (F.pow("own", F.lit(power)) * F.lit((total or 0) / (scale or 1))).alias(f"want_{dimension}"))


def given(cells: DataFrame, dimension: str, shares: Mapping[str, float]) -> DataFrame:
    """Target tokens by shares; values without a share get none."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").alias("own"))
    listed = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], f"{dimension} string, share double")
    both = own.join(listed, dimension, "left").na.fill(0.0, ["share"]).where("own > 0")
    total = both.agg(F.sum("own")).first()[0] or 0
    scale = both.agg(F.sum("share")).first()[0] or 1
    return both.select(dimension, (F.col("share") * F.lit(total / scale)).alias(f"want_{dimension}"))


def goes_on(before: float, now: float) -> bool:
    """Whether another few sweeps are worth it."""
    return now > CLOSE and now < before * (1 - FALL)


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]]) -> tuple[DataFrame, float]:
    """cells (the dimensions, tokens) with weight, raked to the targets: a power of the own tokens, or shares by value; and the deviation."""
    for d in targets:
        want = tempered(cells, d, targets[d]) if isinstance(targets[d], int | float) else given(cells, d, targets[d])
        cells = cells.join(want, d, "left")
    cells = cut(cells.na.fill(0.0, [f"want_{d}" for d in targets]).withColumn("weight", F.col("tokens").cast("double")))
    total = max(1.0, float(cells.agg(F.sum("tokens")).first()[0] or 0))
    before, now = float("inf"), float("inf")
    while True:
        for _ in range(SWEEPS):
            for d in targets:
                own = F.sum("weight").over(Window.partitionBy(d))
                cells = cells.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(f"want_{d}") / own).otherwise(0.0))
        cells = cut(cells)
        off = [cells.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"want_{d}")).alias("off")).agg(F.sum("off").alias("off")) for d in targets]
        before, now = now, sum(r["off"] or 0.0 for r in reduce(DataFrame.union, off).collect()) / total  # one row for each dimension
        if not goes_on(before, now):
            return cells, now


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """cells with per_token and probability: weight per token, scaled so that budget tokens are expected, 1 at most."""
    per_token = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    cells = cut(cells.withColumn("per_token", per_token))
    scale = 0.0
    while True:  # more cells reach 1 with each step, until none is new
        full = F.col("per_token") * F.lit(scale) >= 1
        certain, rest = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = max(0.0, (budget - (certain or 0)) / rest) if rest else scale
        if not rest or new <= scale * (1 + 1e-9):
            break
        scale = new
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("per_token") * F.lit(scale)))


def rake_arrays(codes: list[np.ndarray], names: list[list[str]], tokens: np.ndarray, targets: list[float | Mapping[str, float]]) -> tuple[np.ndarray, float]:
    """What rake() does, with each dimension's codes and their names: weights and the deviation."""
    total, wants = float(tokens.sum()), []
    for code, own_names, target in zip(codes, names, targets, strict=True):
        own = np.bincount(code, tokens, len(own_names))
        want = own**target if isinstance(target, int | float) else np.where(own > 0, [float(target.get(n, 0.0)) for n in own_names], 0.0)
        wants.append(want * (total / (want.sum() or 1.0)))
    weight, before, now = tokens.astype(np.float64), np.inf, np.inf
    while True:
        for _ in range(SWEEPS):
            for code, want in zip(codes, wants, strict=True):
                own = np.bincount(code, weight, len(want))
                weight = weight * np.where(own > 0, want / np.where(own > 0, own, 1.0), 0.0)[code]
        off = sum(np.abs(np.bincount(code, weight, len(want)) - want).sum() for code, want in zip(codes, wants, strict=True))
        before, now = now, float(off) / max(1.0, total)
        if not goes_on(before, now):
            return weight, now


def calibrate_arrays(tokens: np.ndarray, weight: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """What calibrate() does: weights per token, and probabilities."""
    per_token = np.where(tokens > 0, weight / np.maximum(tokens, 1), 0.0)
    scale = 0.0
    while True:
        full = per_token * scale >= 1
        rest = weight[~full].sum()
        new = max(0.0, (budget - tokens[full].sum()) / rest) if rest else scale
        if not rest or new <= scale * (1 + 1e-9):
            return per_token, np.minimum(1.0, per_token * scale)
        scale = new


def chances(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], fraction: float) -> DataFrame:
    """cells (the dimensions, tokens) -> the dimensions, weight (per token), probability, deviation."""
    spark = cells.sparkSession
    rows = sorted(tuple(r) for r in cells.select(*DIMENSIONS, "tokens").limit(BROADCAST_CELLS + 1).collect())
    if len(rows) > BROADCAST_CELLS:
        cells = cut(cells)
        total = cells.agg(F.sum("tokens")).first()[0] or 0
        raked, off = rake(cells, targets)
        return calibrate(raked, fraction * total).select(*DIMENSIONS, F.col("per_token").alias("weight"), "probability", F.lit(off).alias("deviation"))
    tokens = np.array([r[3] for r in rows], np.int64)
    names, codes = [], []
    for k in range(len(DIMENSIONS)):
        values = sorted({r[k] for r in rows})
        place = {v: i for i, v in enumerate(values)}
        names.append(values)
        codes.append(np.array([place[r[k]] for r in rows], np.int64))
    chosen = [k for k, d in enumerate(DIMENSIONS) if d in targets]
    weight, off = rake_arrays([codes[k] for k in chosen], [names[k] for k in chosen], tokens, [targets[DIMENSIONS[k]] for k in chosen])
    per_token, probability = calibrate_arrays(tokens, weight, fraction * int(tokens.sum()))
    out = [(*r[:3], w, p, off) for r, w, p in zip(rows, per_token.tolist(), probability.tolist(), strict=True)]
    return F.broadcast(spark.createDataFrame(out, ", ".join(f"{d} string" for d in DIMENSIONS) + ", weight double, probability double, deviation double"))


def mix(df: DataFrame, targets: Mapping[str, float | Mapping[str, float]], fraction: float, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """df's columns as struct row, with source, lang, topic, n_tokens, weight (per token), probability, selected, deviation.

    targets: by source, lang and topic, a power of the present tokens or shares by value. fraction: of all tokens."""
    text = text_of(text_col)
    words = word_count(text)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    topic = F.col(topic_col) if topic_col else form_topic(text, words)
    docs = df.select(row, F.col(id_col).alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")), F.coalesce(topic.cast("string"), F.lit("")).alias("topic"), words.alias("n_tokens"))
    cells = chances(docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), targets, fraction)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53))).alias("uniform")
    return docs.join(cells, list(DIMENSIONS)).select("row", *DIMENSIONS, "n_tokens", "weight", "probability", (uniform < F.col("probability")).alias("selected"), "deviation")


#: Production targets: sources and topics by the square root of their tokens, languages by the power 0.7; half the tokens.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
FRACTION = 0.5


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and choice of every document."""
    docs = few(table(spark, sf_dir, "documents")).select("doc_id", "text", "source", "lang")
    return mix(docs, TARGETS, FRACTION).select("row.doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "selected", "deviation")
