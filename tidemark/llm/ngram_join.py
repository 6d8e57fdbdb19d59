"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

The bands and rows are the fewest that find a pair at the threshold with the target recall. Documents with equal n-gram
sets are one class from the start, known by two hashes of the set. Each class is dealt out by its band hashes; in a bucket of two classes or
more, the class with the smallest hash is the pivot, and every class of the bucket joins the pivot's hub, once however many bands
lead to it. A hub's classes are compared all with all on their n-gram sets, as products of incidence matrices; a hub of many classes or
large sets is split into blocks, and each pair of blocks is a task of its own, so no group meets in one task and no pair becomes a row.
A pair in several hubs counts in the one with the smallest pivot. Groups are connected components of the links.

N-grams are of NGRAM words; words are separated by white space and otherwise unchanged. A text of fewer words has its
whole sequence as the only n-gram. Null texts and texts without words have no n-gram, link to nothing and are their own class. Every row
counts as a document: repeated rows are copies of each other, and one id with different texts is a document for each.
A group's class_id is its smallest id, rows with a null id count and link like others, and a group without any id has a null
class_id. Ids must be whole numbers. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, few, map_arrow, parts_for, table, text_of
from tidemark.llm.words import grams, hash_words, mix, portions, spans

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Rows in a band; more rows make fewer chance candidates, but more bands.
ROWS = 4
#: Classes of a hub, and n-grams of them, in one block on average at most.
BLOCK, BLOCK_GRAMS = 512, 500_000
#: Keys among which a large hub's rows are dealt when its size is looked up.
SALTS = 32
#: Columns of an incidence matrix at a time.
COLUMNS = 8192


def choose_bands(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The fewest bands of so many rows that bring a pair at the threshold together with the given chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, in order within a text, and where each text's begin (one more entry)."""
    starts, ends, first = spans(data, offsets)
    words = hash_words(data, starts, ends)
    counts = np.diff(first)
    all_grams = grams(words, n)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = text[: len(all_grams)] == text[n - 1 :] if len(all_grams) else np.zeros(0, bool)
    owner, value = text[: len(all_grams)][whole], all_grams[whole]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        owner = np.append(owner, d)
        value = np.append(value, grams(np.append(words[first[d] : first[d + 1]], np.uint64(counts[d])), int(counts[d]) + 1))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(value: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each non-empty set: sets x bands."""
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, bands), np.uint64)
    if not len(some):
        return out
    random = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    begin = first[some]
    for band in range(bands):
        key = np.full(len(some), band, np.uint64)
        for row in range(rows):
            k = 2 * (band * rows + row)
            key = mix(key * np.uint64(31) + np.minimum.reduceat(mix_once(value, random[k], random[k + 1]), begin))
        out[some, band] = key
    return out


def mix_once(x: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    return x * (a | np.uint64(1)) + b


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_keys(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set."""
    out = []
    for seed in (1, 2):
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value ^ np.uint64(seed * 0x1234567)), out=sums[1:])
        out.append(_signed(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))))
    return out


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """docs (id, th, text) -> id, th, k1, k2 (of the n-gram set; null without n-grams), size, bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        k1, k2, keys, sizes = [], [], [], []
        for _, _, data, offsets in portions(batch.column(2)):
            value, first = sets_of(data, offsets)
            for own, out in zip(set_keys(value, first), (k1, k2), strict=True):
                out.append(own)
            keys.append(_signed(signatures(value, first, bands, rows)))
            sizes.append(np.diff(first))
        size = np.concatenate(sizes)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys).ravel()), bands).cast(pa.list_(pa.int64()))
        hashes = [pa.array(np.concatenate(k), mask=size == 0) for k in (k1, k2)]
        return pa.record_batch([batch.column(0), batch.column(1), *hashes, pa.array(size, pa.int64()), lists], names=["id", "th", "k1", "k2", "size", "bands"])

    return map_arrow(docs, run, "id long, th long, k1 long, k2 long, size long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """docs (text) -> k1, k2, grams (packed distinct n-gram hashes)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        k1, k2, out = [], [], []
        for _, _, data, offsets in portions(batch.column(0)):
            value, first = sets_of(data, offsets)
            for own, keys in zip(set_keys(value, first), (k1, k2), strict=True):
                keys.append(own)
            packed = value.astype("<u8").tobytes()
            out += [packed[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.record_batch([pa.array(np.concatenate(k1)), pa.array(np.concatenate(k2)), pa.array(out, pa.binary())], names=["k1", "k2", "grams"])

    return map_arrow(docs, run, "k1 long, k2 long, grams binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in (left, right)]
    flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    common = np.intersect1d(flat[0], flat[1])
    rows, cols = [], []
    for values, size in zip(flat, sizes, strict=True):
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        hit = common[at] == values if len(common) else np.zeros(len(values), bool)
        row, col = np.repeat(np.arange(len(size)), size)[hit], at[hit]
        order = np.argsort(col, kind="stable")
        rows.append(row[order])
        cols.append(col[order])
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(common), COLUMNS):
        matrices = []
        for side, n in ((0, len(left)), (1, len(right))):
            a, b = np.searchsorted(cols[side], [start, start + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(common) - start)), np.float32)
            m[rows[side][a:b], cols[side][a:b] - start] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out


def local_roots(links: np.ndarray) -> np.ndarray:
    """Smallest index reachable over symmetric links."""
    label = np.arange(len(links))
    while True:
        least = np.where(links, label[None, :], len(links)).min(1, initial=len(links))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Classes of one pair of blocks (i and j, with side 0 and side 1; a block with itself has side 0 alone) -> k1, k2, links, r1, r2: a class linked to it."""
    pdf = pdf.sort_values(["k1", "k2"], kind="stable").reset_index(drop=True)
    sides = [pdf[pdf["side"] == s].reset_index(drop=True) for s in (0, 1)]
    alone = bool(pdf["i"].iloc[0] == pdf["j"].iloc[0])
    if not alone and not (len(sides[0]) and len(sides[1])):  # an empty block
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("k1", "k2", "links", "r1", "r2")})
    a, b = sides[0], sides[0] if alone else sides[1]
    sets = [[np.frombuffer(x, "<u8") for x in side["grams"]] for side in ((a,) if alone else (a, b))]
    shared = shared_counts(sets[0], sets[-1])
    sizes = [np.fromiter(map(len, s), np.float32, len(s)) for s in sets]
    linked = shared >= threshold * (sizes[0][:, None] + sizes[-1][None, :] - shared) - 1e-4
    if alone:
        np.fill_diagonal(linked, False)
    pivot = int(pdf["pivot"].iloc[0])
    counted = linked.copy()
    earlier: dict[int, list[list[int]]] = {}  # smaller pivots that both have: the pair counts there
    for s, side in enumerate((a, b)):
        for i, pivots in enumerate(side["pivots"]):
            for p in pivots:
                if p < pivot:
                    earlier.setdefault(int(p), [[], []])[s].append(i)
    for left, right in earlier.values():
        if left and right:
            counted[np.ix_(left, right)] = False
    weights = [side["n"].to_numpy(np.int64) for side in (a, b)]
    links = counted @ weights[1]
    if not alone:
        links = np.concatenate([links, counted.T @ weights[0]])
        both = np.zeros((len(pdf), len(pdf)), bool)
        both[: len(a), len(a) :] = linked
        both[len(a) :, : len(a)] = linked.T
        linked = both
    keys = a[["k1", "k2"]].to_numpy() if alone else np.concatenate([a[["k1", "k2"]].to_numpy(), b[["k1", "k2"]].to_numpy()])
    root = keys[local_roots(linked)]
    return pd.DataFrame({"k1": keys[:, 0], "k2": keys[:, 1], "links": links.astype(np.int64), "r1": root[:, 0], "r2": root[:, 1]})


def components(edges: DataFrame) -> DataFrame:
    """edges (id, root), written -> id, root: the smallest id that edges lead to. Labels fall along edges, and then to their labels' labels."""
    edges = edges.where("id != root")
    both = edges.select(F.col("id").alias("a"), F.col("root").alias("b")).union(edges.select(F.col("root").alias("a"), F.col("id").alias("b")))
    rows = 2 * edges.count()  # no more labels than that
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), rows)
    while True:
        known = labels.select(F.col("id").alias("via"), F.col("label").alias("to"))
        near = both.join(known, both["b"] == known["via"]).groupBy("a").agg(F.min("to").alias("near"))
        once = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        moved = once.join(known, once["label"] == known["via"]).select("id", "old", F.least("label", "to").alias("label"))
        labels = cut(moved, rows)
        if labels.where("label != old").isEmpty():
            return labels.select("id", F.col("label").alias("root"))
        labels = labels.select("id", "label")


def grouped(df: DataFrame, threshold: float, recall: float, rows: int, id_col: str, text_col: str) -> DataFrame:
    """id, head (none, id, th: the row that stands for the group; null without n-grams), links; a row for each row of df."""
    bands, parts = choose_bands(threshold, recall, rows), parts_for(df)
    text = text_of(text_col)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed = cut(sign(docs, bands, rows), parts=parts)
    # one row stands for a class: the least id (null comes last), and the hash of its text, should the id have several
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    classes = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min(rep).alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    n = signed.count()
    classes = cut(classes, n)
    dealt = classes.select("k1", "k2", "rep", "n", "size", F.explode("bands").alias("bucket"))
    # written, so that the join deals both sides anew and can split a frequent bucket
    buckets = cut(dealt.groupBy("bucket").agg(F.count("*").alias("found"), F.min("k1").alias("pivot")).where("found > 1").select("bucket", "pivot"), n * bands)
    spokes = dealt.join(buckets, "bucket").groupBy("k1", "k2")
    wanted = cut(spokes.agg(F.first("rep").alias("rep"), F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_set("pivot")).alias("pivots")), n)  # a pivot for each band at most
    # only hubs of several blocks are looked up, each under SALTS keys, so that a large hub's rows meet in no one task
    sizes = wanted.select("size", F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_GRAMS))).cast("int").alias("blocks")).where("blocks > 1")
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    reps = wanted.select(F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    texts = docs.join(reps, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th")), "left_semi")
    sets = full_sets(texts.select("text")).groupBy("k1", "k2").agg(F.first("grams").alias("grams"))
    members = wanted.drop("rep", "size").join(sets, ["k1", "k2"])
    placed = members.withColumn("pivot", F.explode("pivots"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "k1"), F.lit(SALTS)).cast("int")).join(sizes, ["pivot", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pivot",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "k1",
        "k2",
        "n",
        "pivots",
        "grams",
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return compare_block(pdf, threshold)

    found = cut(dealt.groupBy("pivot", "i", "j").applyInPandas(compare, "k1 long, k2 long, links long, r1 long, r2 long"), parts=parts)
    links = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.struct("k1", "k2").alias("id"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("root"))).select("id.k1", "id.k2", "root")
    heads = roots.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).groupBy("root").agg(F.min("rep").alias("head"))
    roots = roots.join(heads, "root").select("k1", "k2", "head")
    groups = classes.select("k1", "k2", "rep", "n").join(links, ["k1", "k2"], "left").join(roots, ["k1", "k2"], "left")
    groups = groups.select("k1", "k2", F.coalesce("head", "rep").alias("head"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return signed.select("id", "k1", "k2").join(groups, ["k1", "k2"], "left").select("id", "head", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def ngram_join(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, class_id (smallest id of the group), n_links (other documents at the threshold or above)."""
    found = grouped(df, threshold, recall, rows, id_col, text_col)
    class_id = F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id"))
    return found.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.col("links").alias("n_links"))


def one_of_each(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group the row with the smallest id (of one id's texts in the group, one; of equal rows, one); texts without words all stay."""
    heads = grouped(df, threshold, recall, rows, id_col, text_col).where("head is not null").select(F.col("head.id").alias("head_id"), F.col("head.th").alias("head_th")).distinct()
    text = text_of(text_col)
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")).alias("worded"))
    kept = keyed.where("worded").join(heads, F.col("id").eqNullSafe(F.col("head_id")) & (F.col("th") == F.col("head_th")), "left_semi").dropDuplicates(["id", "th"])
    return kept.union(keyed.where(~F.col("worded"))).select("row.*")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    docs = few(table(spark, sf_dir, "documents"))
    return few(ngram_join(docs), docs)


ORACLE_OP5 = r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as m from g a join g b using (g) where a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where m >= 0.8 * (x.n + y.n - m) - 1e-9),
r as (select doc_id as d, doc_id as root from documents union select l.b, r.root from r join l on l.a = r.d)
select d as doc_id, min(root) as class_id, (select count(*) from l where l.a = d) as n_links from r group by d
"""
