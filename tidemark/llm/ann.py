"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into halves, each quantised by a codebook of its own, so that a vector lies in a cell of two centroids. The
codebooks are fitted on a bounded sample; every vector is indexed. A query walks through cells in order of the sum of its
inner products with the two centroids (a heap over pairs, the largest first), until the cells hold the wanted number of
vectors; these entries are ranked by inner products in double precision on the original vectors.

The wanted number is measured, not set: for a bounded sample of the queries the true neighbours are found by brute force over
all vectors, and a query visits as many vectors as bring the sample the wanted recall. Vectors with structure need few, vectors
without any a good part of the table.

Cells stand on shelves by their first centroid; shelves are split into blocks of bounded numbers of vectors, and the queries that visit
a shelf into blocks too, so that no cell or query set of any size meets in one task. Vectors that are null, zero, of another length than
most of the sample, or hold null or non-finite components take no part; nor do rows without an id. Rows of one id count once, with
the smallest of their vectors in the order of bytes. Equal vectors tie, and ties go to smaller ids. A query's own id is no candidate.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import cut, map_arrow, table

#: Rows on which the codebooks are fitted, on average, at most.
SAMPLE = 20_000
#: Centroids of a half, which grow with the square root of the table, at most (their pairs' counts go to all tasks: 8 MB), and
#: rounds of k-means.
CENTROIDS, ROUNDS = 1024, 10
#: First centroids of a shelf.
SHELF = 8
#: Queries whose true neighbours tell how many vectors to visit, on average, and the recall that these are to reach.
TRIED, RECALL = 128, 0.94
#: Vectors and queries in a block at most, on average.
BLOCK = 4096
NEAREST = 20


def lengths(column: pa.Array) -> np.ndarray:
    """Components of each vector; 0 for null."""
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)


def unpack(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the vectors that take part."""
    rows = np.flatnonzero(lengths(column) == size)
    values = column.values.to_numpy(zero_copy_only=False)  # null components come as NaN
    x = values[column.offsets.to_numpy()[rows][:, None] + np.arange(size)]
    good = np.isfinite(x).all(1) & x.any(1)
    return rows[good], x[good]


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def matrix(column: pa.Array | pd.Series, kind: str) -> np.ndarray:
    """The rows back, in double precision."""
    return np.stack([np.frombuffer(v, kind) for v in column]).astype(np.float64)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids, started from rows spread over the sample."""
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1)[None] - 2 * x @ centroids.T).argmin(1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Cells by falling sum of the two halves' scores until they hold the wanted number of vectors."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    held = counts.tolist()
    heap, cells, got = [(-(x[0] + y[0]), 0, 0)], [], 0
    reached = [0] * len(a)  # how far each row of pairs has been pushed
    reached[0] = 1
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        n = held[a[i]][b[j]]
        if n:
            cells.append((a[i], b[j]))
            got += n
        if j + 1 < len(b) and reached[i] == j + 1 and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
            reached[i] = j + 2
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
            reached[i + 1] = j + 1
    return cells


def position(first: np.ndarray, second: np.ndarray, counts: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many vectors a query visits until it has seen each of some cells (numbers in counts' order)."""
    order = np.argsort(-(first[:, None] + second[None]).ravel(), kind="stable")
    seen = np.empty(counts.size, np.int64)
    seen[order] = np.cumsum(counts.ravel()[order])
    return seen[cells]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores (those that count are finite), best first, ties to smaller ids."""
    n = min(k, int(np.isfinite(scores).sum()))
    if not n:
        return np.zeros(0, np.int64)
    near = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    return near[np.lexsort((ids[near], -scores[near]))[:n]]


def best_of_block(pdf: pd.DataFrame, kind: str, k: int) -> pd.DataFrame:
    """The k best entries of a block for each of its queries, among the cells that the query visits."""
    entries, asked = pdf[~pdf["asks"]].sort_values("id", kind="stable"), pdf[pdf["asks"]]
    out = []
    if len(entries):
        x, ids, cell = matrix(entries["vector"], kind), entries["id"].to_numpy(), entries["cell"].to_numpy()
        for start in range(0, len(asked), 256):
            part = asked.iloc[start : start + 256]
            q = matrix(part["vector"], kind)
            visits = np.unpackbits(np.stack([np.frombuffer(m, np.uint8) for m in part["visits"]]), axis=1)
            rough = q @ x.T
            rough[visits[:, cell] == 0] = -np.inf
            rough[part["id"].to_numpy()[:, None] == ids[None]] = -np.inf
            for i, own in enumerate(part["id"].tolist()):
                row = rough[i]
                n = min(k, int(np.isfinite(row).sum()))
                if not n:
                    continue
                least = np.partition(row, len(row) - n)[len(row) - n]
                near = np.flatnonzero(row >= least - 1e-9 * (1 + abs(least)))  # equal vectors may differ in the last bits here
                exact = (x[near] * q[i]).sum(1)
                keep = np.lexsort((ids[near], -exact))[:n]
                out.append((np.full(n, own), ids[near][keep], exact[keep]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def once(index: DataFrame) -> DataFrame:
    """The index with one row for each id; only ids are shuffled to find those that repeat."""
    again = cut(index.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if again.isEmpty():
        return index
    least = index.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("vector", "a", "b")).alias("v")).select("id", "v.*")
    return cut(index.join(again, "id", "left_anti").union(least))


def share_of(ids: F.Column, seed: int, wanted: int, n: int) -> F.Column:
    """Chooses about the wanted number of n rows by a hash of the id."""
    return F.lit(True) if n <= wanted else F.pmod(F.xxhash64(F.lit(seed), ids), F.lit(1_000_000_000)) < int(1_000_000_000 * wanted / n)


def search(df: DataFrame, every: int, k: int = NEAREST, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for the rows whose id is divisible by every."""
    spark = df.sparkSession
    single = isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    kind, plain = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(plain).alias("vector"))
    n = rows.count()
    chosen = rows.where(share_of(F.col("id"), 4, SAMPLE, n)).orderBy("id").select("vector").toArrow().column(0).combine_chunks()  # about SAMPLE rows
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = np.bincount(lengths(chosen))[1:] if len(chosen) else np.zeros(0)
    size = int(sizes.argmax()) + 1 if len(sizes) and sizes.any() else 0
    sample = unpack(chosen, size)[1].astype(np.float64) if size else np.zeros((0, 0))
    if not len(sample):
        return spark.createDataFrame([], schema)
    half = (size + 1) // 2
    centroids = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(n) / 1.5))), 2, CENTROIDS))
    books = spark.sparkContext.broadcast((k_means(sample[:, :half], centroids), k_means(sample[:, half:], centroids)))
    width = len(books.value[1])

    def quantise(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, x = unpack(batch.column(1), size)
        a, b = (nearest(part.astype(np.float64), book) for part, book in zip((x[:, :half], x[:, half:]), books.value, strict=True))
        return pa.record_batch([batch.column(0).take(pa.array(own)), packed(x.astype(kind)), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["id", "vector", "a", "b"])

    index = once(cut(map_arrow(rows, quantise, "id long, vector binary, a int, b int")))
    counts = np.zeros((len(books.value[0]), width), np.int64)
    for a, b, m in index.groupBy("a", "b").count().collect():  # a row for each cell at most
        counts[a, b] = m
    asking = index.where(F.col("id") % every == 0)
    queries = asking.count()

    # how many vectors to visit
    tried = asking.where(share_of(F.col("id"), 5, TRIED, queries)).select("id", "vector").orderBy("id").collect()  # about TRIED rows
    if not tried:
        return spark.createDataFrame([], schema)
    tests = spark.sparkContext.broadcast((np.array([r["id"] for r in tried]), matrix([bytes(r["vector"]) for r in tried], kind)))

    def true_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition, the k best for each tried query."""
        own, q = tests.value
        held = [[np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in own]
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64) * width + batch.column(3).to_numpy()
            scores = q @ matrix(batch.column(1).to_pylist(), kind).T if len(ids) else np.zeros((len(own), 0))
            scores[own[:, None] == ids[None]] = -np.inf
            for i, row in enumerate(scores):
                both = [np.concatenate(pair) for pair in zip(held[i], (row, ids, cell), strict=True)]
                keep = best(both[0], both[1], k)
                held[i] = [c[keep] for c in both]
        query = np.repeat(np.arange(len(own)), [len(h[0]) for h in held])
        columns = [np.concatenate([h[c] for h in held]) for c in range(3)]
        yield pa.record_batch([pa.array(query), *map(pa.array, columns)], names=["query", "score", "id", "cell"])

    near = index.mapInArrow(true_neighbours, "query long, score double, id long, cell long")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    cells: dict[int, list[int]] = {}
    for r in near.select("query", "cell").collect():  # k for each tried query
        cells.setdefault(r["query"], []).append(r["cell"])
    q = tests.value[1]
    seen = [position(books.value[0] @ q[i, :half], books.value[1] @ q[i, half:], counts, np.array(own)) for i, own in cells.items()]
    wanted = float(np.quantile(np.concatenate(seen), recall, method="higher")) if seen else 0.0

    held = spark.sparkContext.broadcast(counts)
    shelves = -(-len(counts) // SHELF)

    def visits(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, vectors, shelf, masks = [], [], [], []
        for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            q = np.frombuffer(vector, kind).astype(np.float64)
            on = np.zeros((shelves * SHELF, width), np.uint8)
            walked = np.array(traverse(books.value[0] @ q[:half], books.value[1] @ q[half:], held.value, wanted), np.int64).reshape(-1, 2)
            on[walked[:, 0], walked[:, 1]] = 1
            for s in np.unique(walked[:, 0] // SHELF).tolist():
                ids.append(i)
                vectors.append(vector)
                shelf.append(s)
                masks.append(np.packbits(on[s * SHELF : (s + 1) * SHELF].ravel()).tobytes())
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(shelf, pa.int32()), pa.array(masks, pa.binary())], names=["id", "vector", "shelf", "visits"])

    asked = cut(map_arrow(asking.select("id", "vector"), visits, "id long, vector binary, shelf int, visits binary"))
    visitors = {r["shelf"]: r["count"] for r in asked.groupBy("shelf").count().collect()}  # a row for each shelf at most

    def blocks_of(sizes: list[int]) -> F.Column:
        return F.element_at(F.array(*(F.lit(max(1, -(-int(m) // BLOCK))) for m in sizes)), F.col("shelf") + 1)

    blocks = blocks_of([counts[s * SHELF : (s + 1) * SHELF].sum() for s in range(shelves)])
    query_blocks = blocks_of([visitors.get(s, 0) for s in range(shelves)])
    entries = index.withColumn("shelf", F.floor(F.col("a") / SHELF).cast("int")).where(F.col("shelf").isin(list(visitors))).select(
        F.lit(False).alias("asks"), "id", "vector", ((F.col("a") - F.col("shelf") * SHELF) * width + F.col("b")).alias("cell"), F.lit(None).cast("binary").alias("visits"), "shelf",
        F.pmod(F.xxhash64(F.lit(1), "id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("query_block"),
    )
    asked = asked.select(
        F.lit(True).alias("asks"), "id", "vector", F.lit(0).alias("cell"), "visits", "shelf",
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(2), "id"), query_blocks).cast("int").alias("query_block"),
    )

    def rank_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return best_of_block(pdf, kind, k)

    found = entries.union(asked).groupBy("shelf", "block", "query_block").applyInPandas(rank_block, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every twentieth."""
    return search(table(spark, sf_dir, "embeddings"), every=20)
