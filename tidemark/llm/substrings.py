"""Substring dedup: windows of words that occur more than once are found with a compressed FM-index per shard, and removed.

A window's key is the least hash of its short n-grams, so equal windows have equal keys. Consecutive windows with one key make a
stretch, and each window of the corpus is in just one stretch. Stretches alone under their key, without a repeat inside,
are done. Of stretches that occur word for word more than once, one stands for all. The others and these are gathered by
key in shards of bounded numbers of words; a shard's distinct stretches make its FM-index, in which one that stands for several counts as such. All
are streamed through it: backward search over the wavelet matrix gives their matching statistics, windows above the threshold
are reported, and what is found in a stretch holds for all its copies. Keys with more distinct stretches than a shard can hold are settled by
counting: by their windows' hashes, and as a whole where a stretch has copies.

Words are runs other than white space, unchanged. Windows and stretches count as the same if both their keys and the 64-bit hashes of their words
are the same, so two different ones under one key are taken for the same with a chance of 2**-64. Inside a shard, words are told apart by their
64-bit hashes. Null texts have no words. Repeated rows (same id and text) count as occurrences, and lose the same words. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, few, map_arrow, parts_for, table, text_of
from tidemark.llm.fm_index import FMIndex, occurs, repeated_windows
from tidemark.llm.words import BASE, INVERSE, grams, hash_words, mix, portions, spans

#: Words of a window, and of the n-grams among which a window's key is chosen.
WINDOW, GRAM = 35, 8
#: Words of a shard, on average at most.
SHARD_WORDS = 100_000
#: Distinct stretches of a key beyond which it is settled by windows.
HOT = 2_000
#: Windows that one lane of the search looks at.
LANE = 8


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Stretches:
    """The stretches of some texts: text, first word within the text, windows, key, hash of the words, repeats inside possible."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        starts, ends, first = spans(data, offsets)
        self.starts, self.ends, self.first = starts, ends, first
        n = len(starts) - window + 1
        empty = np.zeros(0, np.int64)
        self.text, self.at, self.windows, self.key, self.content, self.loops, self.window_hash = empty, empty, empty, empty, empty, empty.astype(bool), empty
        if n <= 0:
            return
        words = hash_words(data, starts, ends)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = owner[:n] == owner[window - 1 :]
        g = grams(words, gram)
        width = window - gram + 1
        key = slide_min(g, width)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | ~inside[:-1]
        over = np.ones(n, bool)
        over[:-1] = new[1:] | ~inside[1:]
        begin, last = np.flatnonzero(new & inside), np.flatnonzero(over & inside)
        if not len(begin):
            return
        powers = np.full(len(words) + 1, BASE, np.uint64)
        inverses = np.full(len(words) + 1, INVERSE, np.uint64)
        powers[0] = inverses[0] = 1
        powers, inverses = np.cumprod(powers), np.cumprod(inverses)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[:-1], out=sums[1:])
        self.content = mix((sums[last + window] - sums[begin]) * inverses[begin] + (last - begin).astype(np.uint64)).view(np.int64)
        self.window_hash = mix((sums[window:] - sums[:n]) * inverses[:n]).view(np.int64)
        places = np.arange(width)
        left = begin + (g[begin[:, None] + places] == key[begin][:, None]).argmax(1)
        right = last + width - 1 - (g[last[:, None] + places[::-1]] == key[last][:, None]).argmax(1)
        self.loops = left != right
        self.text, self.windows, self.key = owner[begin], last - begin + 1, key[begin].view(np.int64)
        self.begin, self.at = begin, begin - first[owner[begin]]


def stretches_of(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """docs (row, text) -> a row for each stretch with the asked columns of row, key, content, at, windows, loops."""
    kinds = {"row": "long", "key": "long", "content": "long", "at": "int", "windows": "int", "loops": "boolean"}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        parts: dict[str, list[np.ndarray]] = {c: [] for c in columns}
        for start, _, data, offsets in portions(batch.column(1)):
            s = Stretches(data, offsets)
            own = {"row": rows[start + s.text], "key": s.key, "content": s.content, "at": s.at.astype(np.int32), "windows": s.windows.astype(np.int32), "loops": s.loops}
            for c in columns:
                parts[c].append(own[c])
        return pa.record_batch([pa.array(np.concatenate(parts[c])) for c in columns], names=list(columns))

    return map_arrow(docs, run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def stretch_texts(docs: DataFrame) -> DataFrame:
    """docs (row, text, wanted: array of (at, windows, key, content, single, hot)) -> key, content, row, at, windows, single, words, hashes.

    words: the stretch's text; hashes: of its windows, for hot keys, instead."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        rows, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for start, _, data, offsets in portions(batch.column(1)):
            hot = any(w["hot"] for own in wanted[start : start + len(offsets) - 1] for w in own)
            s = Stretches(data, offsets) if hot else None
            starts, ends, first = spans(data, offsets)
            raw = data.tobytes()
            for i in range(len(offsets) - 1):
                for w in wanted[start + i]:
                    a = int(first[i]) + w["at"]
                    words = None if w["hot"] else raw[starts[a] : ends[a + w["windows"] + WINDOW - 2]]
                    hashes = s.window_hash[a : a + w["windows"]].tolist() if w["hot"] else None
                    out.append((w["key"], w["content"], rows[start + i], w["at"], w["windows"], w["single"], words, hashes))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64()))
        names = ["key", "content", "row", "at", "windows", "single", "words", "hashes"]
        return pa.record_batch([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)

    return map_arrow(docs, run, "key long, content long, row long, at int, windows int, single boolean, words binary, hashes array<long>")


def search_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's stretches -> key, content, row, at, single, from, to: of each the covered words, counted from its start."""
    several = ~pdf["single"].to_numpy()
    texts = pa.array(pdf["words"].tolist(), pa.large_binary())
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
    starts, ends, first = spans(data, offsets)
    names, symbols = np.unique(hash_words(data, starts, ends), return_inverse=True)
    # a separator, 0, after each stretch
    counts = np.diff(first)
    shift = np.repeat(np.arange(len(counts)), counts)
    text = np.zeros(len(symbols) + len(counts), np.int64)
    text[np.arange(len(symbols)) + shift] = symbols + 1
    begin = first[:-1] + np.arange(len(counts))
    index = FMIndex(text, len(names) + 1)
    # what has copies is searched for as a whole: each place where it is stands for two at least, so all its windows count
    whole = np.flatnonzero(several)
    whole = whole[occurs(index, text, begin[whole], begin[whole] + counts[whole], 1)]
    single = np.setdiff1d(np.arange(len(pdf)), whole)
    windows = pdf["windows"].to_numpy(np.int64)[single]
    lanes = -(-windows // LANE)
    lane = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    owner = np.repeat(single, lanes)
    low = begin[owner] + lane * LANE
    high = np.minimum(low + LANE + WINDOW - 1, begin[owner] + counts[owner])
    found = repeated_windows(index, text, low, high, WINDOW)
    stretch = np.searchsorted(begin, found, "right") - 1
    where = found - begin[stretch]
    # windows side by side are one interval
    new = np.ones(len(found), bool)
    new[1:] = (stretch[1:] != stretch[:-1]) | (found[1:] != found[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(found)) - 1 if len(head) else head
    own = pdf.iloc[np.concatenate([stretch[head], whole])]
    spans_found = {"from": np.concatenate([where[head], np.zeros(len(whole), np.int64)]), "to": np.concatenate([where[tail] + WINDOW, counts[whole]])}
    return pd.DataFrame({c: own[c].to_numpy() for c in ("key", "content", "row", "at", "single")} | spans_found)


def repeated_spans(docs: DataFrame, parts: int) -> DataFrame:
    """docs (row, text), with tables in so many parts on the way -> row, from, to: stretches of words that windows found elsewhere cover."""
    keys = stretches_of(docs, ("key", "loops")).groupBy("key").agg(F.count("*").alias("total"), F.max("loops").alias("loops"))
    keys = cut(keys.where("total > 1 or loops").select("key"), parts=parts)  # written, so that a join deals both sides anew and can split a frequent key
    some = cut(stretches_of(docs, ("row", "key", "content", "at", "windows", "loops")).join(keys, "key"), parts=parts)
    order = F.struct("row", "at", "windows")
    kinds = some.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(order).alias("one"), F.max("loops").alias("loops"))
    kinds = cut(kinds, parts=parts)
    kinds = cut(kinds.join(cut(kinds.groupBy("key").agg(F.count("*").alias("kinds")), parts=parts), "key"), parts=parts)
    asked = kinds.where("kinds > 1 or n > 1 or loops")
    single, hot = (F.col("n") == 1).alias("single"), (F.col("kinds") > HOT).alias("hot")
    wanted = asked.select(F.col("one.row").alias("row"), F.struct(F.col("one.at").alias("at"), F.col("one.windows").alias("windows"), "key", "content", single, hot).alias("want"))
    wanted = wanted.groupBy("row").agg(F.collect_list("want").alias("wanted"))
    chosen, again = docs.join(wanted, "row").select("row", "text", "wanted"), cut(docs.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), parts=parts)
    if not again.isEmpty():  # of rows with equal ids and texts one will do
        chosen = chosen.join(again, "row", "left_anti").union(chosen.join(again, "row", "left_semi").dropDuplicates(["row"]))
    texts = stretch_texts(chosen)
    words = asked.where(~hot).agg(F.sum(F.col("one.windows") + WINDOW)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    sharded = texts.where("words is not null").select(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(shards)).alias("shard"), "key", "content", "row", "at", "windows", "single", "words")
    found = sharded.groupBy("shard").applyInPandas(search_shard, "key long, content long, row long, at int, single boolean, from long, to long")
    counted = texts.where("hashes is not null").select("key", "content", "row", "at", "single", F.posexplode("hashes").alias("i", "hash"))
    often = counted.groupBy("key", "hash").agg(F.count("*").alias("n")).where("n > 1").select("key", "hash")
    settled = counted.join(often, ["key", "hash"], "left_semi").where("single").select("key", "content", "row", "at", "single", F.col("i").cast("long").alias("from"), (F.col("i") + WINDOW).cast("long").alias("to"))
    found = cut(found.union(settled), parts=parts)  # in one job, so the texts are dealt once
    streamed = found.where("single").select("row", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to"))
    copies = some.select("key", "content", F.col("row").alias("copy"), F.col("at").alias("place"))
    spread = found.where("not single").join(copies, ["key", "content"]).select(F.col("copy").alias("row"), (F.col("place") + F.col("from")).alias("from"), (F.col("place") + F.col("to")).alias("to"))
    whole = some.join(kinds.where(hot & ~single).select("key", "content"), ["key", "content"], "left_semi").select("row", F.col("at").cast("long").alias("from"), (F.col("at") + F.col("windows") + WINDOW - 1).cast("long").alias("to"))
    return streamed.union(spread).union(whole)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept (the kept words, joined by single spaces); one row for each row of df."""
    text = text_of(text_col)
    docs = df.select(F.xxhash64(F.col(id_col), text).alias("row"), text.cast("binary").alias("text"), F.col(id_col).alias("id"))
    found = cut(repeated_spans(docs.select("row", "text"), parts_for(df)).groupBy("row").agg(F.collect_set(F.struct("from", "to")).alias("spans")), parts=parts_for(df))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals, removed, kept = [], [], []
        for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            totals.append(len(words))
            if own:
                stay = np.ones(len(words), bool)
                for s in own:
                    stay[s["from"] : s["to"]] = False
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            removed.append(totals[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return pa.record_batch([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    both = docs.join(found, "row", "left").select("id", "text", "spans")
    return map_arrow(both, run, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words that repeated windows cover."""
    docs = few(table(spark, sf_dir, "documents"))
    return few(drop_repeats(docs), docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_OP3 = """
with words as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (select r, s, md5(array_to_string(w[s : s + 34], ' ')) as h from (select r, w, unnest(range(1, len(w) - 33)) as s from words where len(w) >= 35)),
often as (select h from windows group by h having count(*) > 1),
covered as (select r, list_distinct(flatten(list(range(s, s + 35)))) as c from windows where h in (select h from often) group by r),
kept as (select doc_id, len(w) as n, coalesce(len(c), 0) as m, case when c is null then w else [x.v for x in list_transform(w, lambda v, i: {'v': v, 'i': i}) if not list_contains(c, x.i)] end as k
         from words left join covered using (r))
select doc_id, n::bigint as n_words, m::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
