"""URL filters: rules first, then words of the host and path weighed by naive Bayes.

Concatenated host names are split into words by a unigram Viterbi search. The unigram counts are over all hosts of the table: a word counts
once for each registered domain (the last two labels) that has it as a separated part of a label, such as both parts of ``big-sale``; it takes
two domains, so no name makes a word of itself, and a name that stands alone in its label makes none. Listed words count besides. The
words are a table, joined to the substrings of each distinct name, so their number has no bound; a word has at most MOST letters, as a
label of a host name has.

Multinomial naive Bayes counts the tokens of all rows, each token by itself: the words of the split host, and the path's words between
other characters; a run of digits is one token. Rows learn their class from voters that agree: a rule's verdict, and whether the host
has a word known as unwanted. A row that a rule allows in spite of such a word teaches nothing. Scores are summed for each distinct host and
each distinct sequence of path words, so a frequent host or path is counted once.

A null URL, or one without ``://``, has an empty host and path, fits no rule, and gets the verdict of the prior alone.
Repeated rows and rows with a null id each give a row. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, few, map_arrow, parts_for, table

#: Words that mark an unwanted host.
UNWANTED = "adult ads bet bets casino cheap farm free gambling loan pills poker porn prize sex spam track tracker viagra win xxx".split()
#: Further words that names are often made of.
COMMON = (
    "about app art auto bank best big blog board book books box business buy car care city class click club code college com "
    "company computer cool daily data day deal deals design digital direct drive easy edu energy event example family fashion "
    "fast film find fire fit food forum fun game games garden girl global go gold good green group guide hand head health help "
    "home hot hotel house info job jobs kids land law learn life light line link list live local love mail market master media "
    "men mobile money movie music my net network new news nice night office one online open org park party phone photo play "
    "plus point post power press price pro quick radio real red report review rock safe sale school science search shop show "
    "site smart social soft sport sports star start station store street style sun super team tech test time top town toy trade "
    "travel tree tube tv video view water web wiki wine women wood word work world zone"
).split()
#: What each listed word counts for, besides its hosts.
LISTED = 5
#: Domains that a word that isn't listed has at least.
LEAST_DOMAINS = 2
#: Letters of a word at most: those of a host name's label.
MOST = 63
#: Smoothing of naive Bayes.
SMOOTHING = 0.1
#: Substrings that a worker sends on at a time.
BATCH = 50_000
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        cut = text.index("/")
        name, start = text[:cut], text[cut:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


class Splitter:
    """Unigram Viterbi over letters; an unknown word's chance falls tenfold with each letter. total: of the counts of all words."""

    def __init__(self, counts: Mapping[str, int], total: float):
        self.logs = {w: math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)
        self.unknown = math.log(10 / total)

    def word(self, w: str) -> float:
        return self.logs.get(w, self.unknown - math.log(10) * len(w))

    def split(self, name: str) -> list[str]:
        """Unknown words are runs of letters that cost as much each, after a first cost, so the search is as long as the longest word."""
        best, back = [0.0], [0]
        inside, begun = -math.inf, 0  # best score with an unknown word that is still open, and where it began
        for end in range(1, len(name) + 1):
            fresh = best[end - 1] + self.unknown
            if fresh > inside:
                inside, begun = fresh, end - 1
            inside -= math.log(10)
            score, start = inside, begun
            for s in range(max(0, end - self.longest), end):
                log = self.logs.get(name[s:end])
                if log is not None and best[s] + log > score:
                    score, start = best[s] + log, s
            best.append(score)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


def tokens_of(text: Column) -> Column:
    """Runs of letters, lower-cased, and # for each run of digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0)), lambda t: F.when(t.rlike(r"\A\p{Nd}"), "#").otherwise(F.lower(t)))


def listed_words() -> dict[str, int]:
    return dict.fromkeys(COMMON + UNWANTED, LISTED)


def word_counts(hosts: DataFrame) -> DataFrame:
    """hosts (distinct) -> word, n: domains with the word as a separated part of a label."""
    labels = F.split("host", r"\.")
    parts = hosts.select(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), F.explode(labels).alias("label"))
    parts = parts.select("domain", F.filter(tokens_of(F.col("label")), lambda t: t != "#").alias("parts")).where(F.size("parts") > 1)
    words = parts.select("domain", F.explode("parts").alias("word")).where((F.length("word") <= MOST) & ~F.col("word").isin(list(listed_words())))
    return words.distinct().groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOMAINS)


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """names (name, distinct), words (word, n) -> name, pieces."""
    listed = listed_words()
    total = float(words.agg(F.sum("n")).first()[0] or 0) + sum(listed.values()) + 1

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each name its hash and all it might hold as words."""
        keys, parts = [], []

        def full() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(keys, pa.string()), pa.array(parts, pa.string())], names=["key", "word"])
            keys.clear()
            parts.clear()
            return out

        for batch in batches:
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in range(len(name)):
                    own = [name[s:e] for e in range(s + 1, min(len(name), s + MOST) + 1)]
                    keys += [key] * len(own)
                    parts += own
                    if len(parts) >= BATCH:
                        yield full()
        yield full()

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out.append(Splitter(listed | {w["word"]: w["n"] for w in found or ()}, total).split(name))
        return pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "pieces"])

    keyed = names.select(F.md5(F.col("name").cast("binary")).alias("key"), "name")
    found = keyed.mapInArrow(substrings, "key string, word string").join(words, "word").groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("found"))
    return map_arrow(keyed.join(found, "key", "left").select("name", "found"), search, "name string, pieces array<string>")


def split_hosts(hosts: DataFrame, parts_made: int) -> DataFrame:
    """hosts (distinct), written in so many parts -> host, words (in order, # for digits), unwanted."""
    parts = cut(hosts.select("host", F.posexplode(tokens_of(F.col("host"))).alias("at", "name")), parts=parts_made)
    pieces = split_names(parts.where("name != '#'").select("name").distinct(), word_counts(hosts))
    each = parts.join(pieces, "name", "left").select("host", "at", F.coalesce("pieces", F.array("name")).alias("pieces"))
    words = each.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "pieces"))), lambda x: x["pieces"])).alias("words"))
    out = hosts.join(words, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    return cut(out.withColumn("unwanted", F.arrays_overlap("words", F.array(*map(F.lit, UNWANTED)))), parts=parts_made)


def token_counts(grouped: DataFrame, mark: str) -> DataFrame:
    """grouped (words, blocked, n) -> token, blocked, n."""
    each = grouped.select(F.explode("words").alias("word"), "blocked", "n")
    return each.groupBy(F.concat(F.lit(mark), "word").alias("token"), "blocked").agg(F.sum("n").alias("n"))


def bayes(counts: DataFrame, parts: int) -> tuple[DataFrame, float]:
    """counts (token, blocked, n), written in so many parts -> token, weight: its log odds of block; and the weight of a token never seen."""
    spark = counts.sparkSession
    known = [("h:" + w, True, LISTED) for w in UNWANTED] + [("h:" + w, False, LISTED) for w in COMMON]
    both = counts.union(spark.createDataFrame(known, "token string, blocked boolean, n long"))
    seen = cut(both.groupBy("token").agg(F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("blocked"), 0).otherwise(F.col("n"))).alias("allow")), parts=parts)
    block, allow, kinds = seen.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    unseen = math.log((allow + SMOOTHING * kinds) / (block + SMOOTHING * kinds))
    return seen.select("token", (F.log(F.col("block") + SMOOTHING) - F.log(F.col("allow") + SMOOTHING) + F.lit(unseen)).alias("weight")), unseen


def summed(keyed: DataFrame, key: str, mark: str, weights: DataFrame, unseen: float) -> DataFrame:
    """keyed (key, distinct; words) -> key, the sum of its tokens' weights."""
    each = keyed.select(key, F.explode("words").alias("word")).groupBy(key, F.concat(F.lit(mark), "word").alias("token")).agg(F.count("*").alias("times"))
    return each.join(weights, "token", "left").groupBy(key).agg(F.sum(F.col("times") * F.coalesce("weight", F.lit(unseen))).alias(f"{key}_score"))


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", teaches: Column | None = None) -> DataFrame:
    """id_col, host, path, words (of host and path), rule, score (log odds of block), verdict. teaches: rows that count (all by default)."""
    url, parts = F.col(url_col).cast("string"), parts_for(df)
    parsed = df.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), (F.lit(True) if teaches is None else F.coalesce(teaches, F.lit(False))).alias("teaches"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.array_join(tokens_of(F.col("path")), " ").alias("path_words"))
    hosts = split_hosts(parsed.select("host").distinct(), parts)
    known = parsed.where("teaches").join(hosts.select("host", "unwanted"), "host")
    blocked = F.when(F.col("by_rule") == "block", True).when(F.col("by_rule").isNull(), F.col("unwanted")).when(~F.col("unwanted"), False)
    known = known.withColumn("blocked", blocked).where("blocked is not null")
    by_host = cut(known.groupBy("host", "blocked").agg(F.count("*").alias("n")), parts=parts)
    by_path = known.where("path_words != ''").groupBy("path_words", "blocked").agg(F.count("*").alias("n"))
    in_path = F.split("path_words", " ")
    counts = token_counts(by_host.join(hosts, "host").select("words", "blocked", "n"), "h:").union(token_counts(by_path.select(in_path.alias("words"), "blocked", "n"), "p:"))
    weights, unseen = bayes(counts, parts)
    n = {r["blocked"]: r["n"] for r in by_host.groupBy("blocked").agg(F.sum("n").alias("n")).collect()}
    prior = math.log((n.get(True, 0) + 1) / (n.get(False, 0) + 1))
    # both tables of scores are written, so that the joins deal both sides anew and can split a frequent host or path
    host_scores = cut(hosts.select("host", F.array_join("words", " ").alias("host_words")).join(summed(hosts, "host", "h:", weights, unseen), "host", "left"), parts=parts)
    paths = parsed.where("path_words != ''").select("path_words").distinct()
    path_scores = cut(summed(paths.select("path_words", in_path.alias("words")), "path_words", "p:", weights, unseen), parts=parts)
    score = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_words_score", F.lit(0.0))
    judged = parsed.join(host_scores, "host").join(path_scores, "path_words", "left").withColumn("score", score)
    words = F.trim(F.concat_ws(" ", "host_words", "path_words")).alias("words")
    return judged.select(F.col("id").alias(id_col), "host", "path", words, "rule", "score", F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = few(table(spark, sf_dir, "pages"))
    return few(judge_urls(pages, RULES), pages).select("page_id", "host", "path", "rule", "verdict", "words", "score")
