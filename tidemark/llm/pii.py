"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans (e-mail and IP addresses, card and phone numbers) come from patterns and checks of their own. They are the seeds, each span
one, with or without spaces in it (of spans that overlap, the first). The one or two words before a seed, or before the token it begins in, are
a context. Other tokens with a digit or an at sign are candidates; digit groups that follow one another on a line are one candidate.
Contexts and tokens (seeds and candidates) form a graph, counted over the whole table; in turn, a
context's confidence is the smoothed share of seed-like tokens after it, and a token's score is the chance that at least
one of its contexts tells the truth. Confident contexts mark tokens that no base pattern knows. A context ends at a word that may
be an identifier itself; shorter words with digits belong to it, and all numbers in them count as the same.

Offsets count code points, ends are exclusive. A null text counts as empty and has no spans. Repeated rows (same id and
text) have the same spans. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, few, parts_for, table, text_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no run of characters is walked through twice: quantifiers are possessive, and a
#: match begins at the start of a run or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an at sign: what may be an identifier.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Shortest token that a context may mark.
SHORTEST = 6
#: Longest word of a context, gap beside one, and part of a token before the span in it; longer ones make no context.
LONGEST_WORD, LONGEST_GAP, LONGEST_HEAD = 32, 4, 16
#: Characters before a span that these can take, and one more.
REACH = 2 * (LONGEST_WORD + LONGEST_GAP) + LONGEST_HEAD + 1
#: Different seeds that a context has at least, the confidence from which it marks tokens, and what smoothes it.
LEAST_SEEDS, CONFIDENT, SMOOTHING = 5, 0.6, 2.0
ROUNDS = 3
#: A token that is a group of digits, and the end of one after which no other belongs to the same candidate.
GROUP, LAST_GROUP = r"\A[+(]*+[0-9][0-9()./-]*+[.,;:!?]*+\z", r"[.,;:!?]\z"
#: A word that is no identifier, and the end of the text before a span: up to two such words of the same line, and the head of the span's token.
WORD = rf"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@]{{1,{LONGEST_WORD}}}+|[^\x20\x09-\x0D]{{1,{SHORTEST - 1}}}+)(?![^\x20\x09-\x0D])"
CONTEXT = rf"((?:{WORD}[\x20\x09]{{1,{LONGEST_GAP}}}+)?{WORD}[\x20\x09]{{1,{LONGEST_GAP}}}+)[^\x20\x09-\x0D]{{0,{LONGEST_HEAD}}}+\z"
#: What a text with matches of a base pattern has.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Characters of a piece in which a text is cut, so that a place far inside is found without a walk from the start.
PIECE = 1024
#: Powers of two for running totals and searches: texts have fewer matches.
LEVELS = 28

SPAN = "array<struct<start:int,kind:int,end:int>>"
#: A seed or candidate.
PLACE = "struct<start:int,kind:int,end:int,token:bigint,context:string>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        number = digits(match)
        return (F.length(match) >= 12) & F.length(number).between(12, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def powers(falling: bool = False) -> Column:
    return F.array(*(F.lit(1 << k) for k in sorted(range(LEVELS), reverse=falling)))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array, by doubling: n log n, where appending one by one would copy n * n."""

    def double(own: Column, step: Column) -> Column:
        return F.transform(own, lambda x, i: F.coalesce(combine(x, F.get(own, i - step)), x))

    return let(values, lambda v: F.aggregate(F.filter(powers(), lambda p: p < F.size(v)), v, double))


def ends_of(pieces: Column, matches: Column) -> Column:
    """Where the matches end, from the pieces between them."""
    return running(F.zip_with(pieces, matches, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0))), lambda a, b: a + b)


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end."""
    first = F.floor(start / PIECE).cast("int")
    own = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
    return F.substr(own, start - first * PIECE + 1, end - start)


def context_of(pieces: Column, start: Column) -> Column:
    """The words before a place."""
    words = F.regexp_extract(part(pieces, F.greatest(start - REACH, F.lit(0)), start), CONTEXT, 1)
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(words)), r"\s+", " "), "[0-9]+", "0")


def place(pieces: Column, start: Column, kind: Column, end: Column, token: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"), F.xxhash64(F.lower(token)).alias("token"), context_of(pieces, start).alias("context"))


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of a kind; places are sums of the lengths of matches and of what is between them."""
    code, none = KINDS.index(kind), F.array().cast(SPAN)

    def places(found: Column) -> Column:
        def spans(ends: Column) -> Column:
            made = F.transform(found, lambda m, i: F.when(valid(kind, m), F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(code).alias("kind"), F.get(ends, i).alias("end"))))
            return F.filter(made, lambda x: x.isNotNull()).cast(SPAN)

        return F.when(F.exists(found, lambda m: valid(kind, m)), let(ends_of(F.split(text, PATTERNS[kind], -1), found), spans)).otherwise(none)

    return F.when(text.rlike(HINTS[kind]), let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), places)).otherwise(none)


def furthest(spans: Column) -> Column:
    """The last end of each span and those before it."""
    return running(F.transform(spans, lambda b: b["end"]), F.greatest)


def seeds_of(base: Column, reach: Column, pieces: Column) -> Column:
    """Of base spans in order, those that overlap none before. reach: furthest(base)."""
    clear = F.filter(base, lambda b, i: (i == 0) | (F.get(reach, i - 1) <= b["start"]))
    return F.transform(clear, lambda b: place(pieces, b["start"], b["kind"], b["end"], part(pieces, b["start"], b["end"])))


def is_free(base: Column, reach: Column, start: Column, end: Column) -> Column:
    """Whether no base span overlaps: of the spans that start before the end, found by bisection, none reaches beyond the start."""
    before = F.aggregate(powers(falling=True), F.lit(0), lambda n, p: F.when(F.get(base, n + p - 1)["start"] < end, n + p).otherwise(n))
    return (F.size(base) == 0) | (F.coalesce(F.get(reach, before - 1), F.lit(0)) <= start)


def candidates(text: Column, base: Column, reach: Column, pieces: Column) -> Column:
    """Tokens outside of base spans that may be identifiers, with the words before them; digit groups in a row are one."""

    def told(found: Column) -> Column:
        between = F.split(text, CANDIDATE, -1)
        return let(between, lambda gaps: let(ends_of(gaps, found), lambda ends: let(tokens(found, gaps, ends), runs)))

    def tokens(found: Column, gaps: Column, ends: Column) -> Column:
        """start, end, free, group, spaced (by blanks from the token before), closed (no group joins it)."""

        def token(m: Column, i: Column) -> Column:
            end = F.get(ends, i)
            start = end - F.length(m)
            return F.struct(
                start.alias("start"), end.alias("end"), is_free(base, reach, start, end).alias("free"), m.rlike(GROUP).alias("group"), F.get(gaps, i).rlike(r"\A[\x20\x09]++\z").alias("spaced"), m.rlike(LAST_GROUP).alias("closed")
            )

        return F.transform(found, token)

    def runs(own: Column) -> Column:
        def joins(i: Column) -> Column:
            x, before = F.get(own, i), F.get(own, i - 1)
            return F.coalesce(x["free"] & x["group"] & before["free"] & before["group"] & x["spaced"] & ~before["closed"], F.lit(False))

        heads = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: ~joins(i))

        def run(heads: Column) -> Column:
            each = F.transform(heads, lambda h, i: F.struct(F.get(own, h)["start"].alias("start"), F.get(own, F.coalesce(F.get(heads, i + 1), F.size(own)) - 1)["end"].alias("end"), F.get(own, h)["free"].alias("free")))
            return F.filter(each, lambda r: r["free"] & (r["end"] - r["start"] >= SHORTEST))

        return F.transform(let(heads, run), closed)

    def closed(r: Column) -> Column:
        bare = F.regexp_replace(part(pieces, r["start"], r["end"]), r"[.,;:!?)\"'\]]+$", "")
        return let(bare, lambda b: place(pieces, r["start"], F.lit(None), r["start"] + F.length(b), b))

    nothing = F.array().cast(f"array<{PLACE}>")
    return F.when(text.rlike("[0-9@]"), let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda found: F.when(F.size(found) > 0, told(found)).otherwise(nothing))).otherwise(nothing)


def score_contexts(edges: DataFrame, rows: int) -> DataFrame:
    """edges (context, token, kind: of the seed in the token, or null; rows of them at most) -> context, kind, confidence.

    Only contexts with enough different seeds of a kind are scored."""
    seeded = edges.where("kind is not null").groupBy("context", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS).drop("seeds")
    graph = cut(edges.select("context", "token", F.col("kind").alias("seed")).join(seeded, "context"), len(KINDS) * rows)
    scored = graph.select("context", "kind", "token", F.when(F.col("seed") == F.col("kind"), 1.0).otherwise(0.0).alias("score"))
    confidence = None
    for _ in range(ROUNDS):
        confidence = cut(scored.groupBy("context", "kind").agg((F.sum("score") / (F.count("*") + F.lit(SMOOTHING))).alias("confidence")), rows)
        spread = graph.join(confidence, ["context", "kind"])
        token = spread.groupBy("token", "kind").agg(F.max(F.when(F.col("seed") == F.col("kind"), 1.0).otherwise(0.0)).alias("known"), (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("told"))
        token = token.select("token", "kind", F.greatest("known", "told").alias("score"))
        scored = graph.select("context", "kind", "token").join(token, ["token", "kind"])
    return confidence


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key (a hash of the text), base and spans: arrays of (start, kind, end), in order; one row for each row of df."""
    text = text_of(text_col)
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"))
    found = docs.select("id", "text", F.array_sort(F.concat(*(base_spans(F.col("text"), kind) for kind in KINDS))).alias("base"))
    found = found.select("*", furthest(F.col("base")).alias("reach"), F.when((F.size("base") > 0) | F.col("text").rlike("[0-9@]"), pieces_of(F.col("text"))).alias("pieces"))
    base, reach, pieces = F.col("base"), F.col("reach"), F.col("pieces")
    places = F.concat(seeds_of(base, reach, pieces), candidates(F.col("text"), base, reach, pieces))
    found = cut(found.select("id", F.md5(F.col("text").cast("binary")).alias("text_key"), "base", F.filter(places, lambda p: p["context"] != "").alias("places")), parts=parts_for(df))
    n = found.agg(F.sum(F.size("places"))).first()[0] or 0
    places = found.where(F.size("places") > 0).select("id", "text_key", F.explode("places").alias("p")).select("id", "text_key", "p.*")
    edges = places.groupBy("context", "token").agg(F.min("kind").alias("kind"))
    strong = score_contexts(edges, n).where(F.col("confidence") >= CONFIDENT)
    best = strong.groupBy("context").agg(F.max(F.struct("confidence", F.col("kind").alias("found"))).alias("best")).select("context", F.col("best.found").alias("found"))
    new = places.where(F.col("kind").isNull() & (F.col("end") - F.col("start") >= SHORTEST)).join(best, "context")
    new = new.groupBy("id", "text_key").agg(F.collect_set(F.struct("start", F.col("found").alias("kind"), "end")).alias("new"))
    both = found.join(new.withColumnRenamed("id", "new_id").withColumnRenamed("text_key", "new_key"), F.col("id").eqNullSafe(F.col("new_id")) & (F.col("text_key") == F.col("new_key")), "left")
    return both.select("id", "text_key", "base", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(SPAN)))).alias("spans"))


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (or run of overlapping spans) replaced by its kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut_out(reach: Column, pieces: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(reach, i - 1), F.lit(0))
            return F.when(s["start"] >= before, F.concat(part(pieces, before, s["start"]), F.get(names, s["kind"]))).otherwise("")

        last = F.get(reach, F.size(reach) - 1)
        return F.concat(F.array_join(F.transform(spans, one), ""), part(pieces, last, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(furthest(spans), lambda reach: let(pieces_of(text), lambda pieces: cut_out(reach, pieces))))


def mask_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with all spans masked in its texts; a null text stays null."""
    found = find_personal(df, id_col, text_col).where(F.size("spans") > 0).groupBy("id", "text_key").agg(F.first("spans").alias("spans")).toDF("pii_id", "pii_key", "pii_spans")
    key = F.md5(text_of(text_col).cast("binary"))
    joined = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), key.alias("key")).join(found, F.col("id").eqNullSafe(F.col("pii_id")) & (F.col("key") == F.col("pii_key")), "left")
    new = F.when(F.col("pii_spans").isNull(), F.col(f"row.`{text_col}`")).otherwise(masked(F.col(f"row.`{text_col}`"), F.col("pii_spans")))
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in df.columns))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    docs = few(table(spark, sf_dir, "documents"))
    found = few(find_personal(docs), docs)

    def count(code: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == code)).cast("long")

    counts = [count(code).alias(f"n_{name}") for code, name in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
