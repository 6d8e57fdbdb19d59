"""Sharding by balanced label propagation: linked documents gather in shards of exactly even numbers of rows.

Documents with equal texts are linked. Each document starts in a shard by its id's hash. Then, round by round, the
members that a group has in one shard move together to the shard where most of the group is and where there is room
for them, small moves first, so a shard never holds more linked documents than its share, until no move is left: each round
that moves anything raises some groups' sums of squared numbers by shard and lowers none, so there is an end. Then, shards with more rows
than their share give unlinked documents first to shards with fewer, so that the numbers of rows differ by one at most.

State is kept by group and first shard, at most one row for each shard and group, so that a group of any size is spread.
Positions come from counts by shard and bucket and ranks within a bucket. A null text has no bytes and equals
other null and empty texts. Rows with equal ids each get a place. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import FILE_ROWS, checkpoint_dir, cut, few, parts_for, table, text_of
from tidemark.operators import files

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Buckets in which ranks are taken, for each shard: by group, by id, and unlinked ones apart.
GROUP_BUCKETS, ID_BUCKETS = 32, 8
#: Buckets of the moves of one size to one shard, in which they are ranked.
MOVE_BUCKETS = 64


def _gather(cells: DataFrame, share: int, shards: int) -> DataFrame:
    """One round: cells (group, first, shard, n) -> the same with new shards, and whether each has moved."""
    load = cells.groupBy("shard").agg(F.sum("n").alias("load"))
    room = F.broadcast(cells.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(load, "shard", "left").select("shard", (F.lit(share) - F.coalesce("load", F.lit(0))).alias("room")))  # one row for each shard
    votes = cells.groupBy("group", "shard").agg(F.sum("n").alias("votes")).join(room, "shard")
    own = votes.select("group", "shard", F.col("votes").alias("stay"), F.col("room").alias("here"))
    other = votes.where("room > 0").select("group", F.struct("votes", F.xxhash64("group", "shard").alias("tie"), F.col("shard").alias("to")).alias("best"), "room")
    # at most shards * shards pairs for a group, as state is kept by group and first shard
    wish = cells.join(other, "group").where("best.to != shard and n <= room").groupBy("group", "first", "shard", "n").agg(F.max("best").alias("best"))
    # of equal shards a hash decides, unless nobody can come to the present one
    moves = wish.join(own, ["group", "shard"]).where("best.votes > stay or (best.votes = stay and (here <= 0 or best.tie > xxhash64(group, shard)))")
    moves = moves.select("group", "first", "n", F.col("best.to").alias("to"), (F.col("best.votes") - F.col("stay")).alias("gain"))
    # small moves first: what is too large for the room left keeps nothing else out. Sums are by size and bucket, ranks within these
    moves = moves.withColumn("bucket", F.pmod(F.xxhash64("group", "first"), F.lit(MOVE_BUCKETS)).cast("int"))
    sums = moves.groupBy("to", "n", "bucket").agg(F.sum("n").alias("all"))
    before = sums.select("to", "n", "bucket", (F.sum("all").over(Window.partitionBy("to").orderBy("n", "bucket")) - F.col("all")).alias("before"))
    before = before.join(room.select(F.col("shard").alias("to"), "room"), "to").where("before + n <= room")
    ranked = moves.join(before, ["to", "n", "bucket"]).withColumn("at", F.row_number().over(Window.partitionBy("to", "n", "bucket").orderBy(F.desc("gain"), "group", "first")))
    granted = ranked.where("before + at * n <= room").select("group", "first", "to")
    return cells.join(granted, ["group", "first"], "left").select("group", "first", F.coalesce("to", "shard").alias("shard"), "n", F.col("to").isNotNull().alias("has_moved"))


def propagate(cells: DataFrame, share: int, shards: int) -> DataFrame:
    """cells (group, first, shard, n) with the shards that they have when no move is left."""
    spark = cells.sparkSession
    # state goes through files: a checkpoint keeps the sizes estimated for joins, whose digits multiply from round to round
    folder, made = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}", 1 + cells.count() // FILE_ROWS
    state, k = cells, 0
    while True:
        _gather(state, share, shards).coalesce(made).write.parquet(f"{folder}/{k}")
        state = spark.read.parquet(f"{folder}/{k}")
        if state.where("has_moved").isEmpty():
            return state.drop("has_moved")
        state, k = state.drop("has_moved"), k + 1
        if k > 1:
            files.delete(spark, f"{folder}/{k - 2}")


def assign_shards(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, group (a hash of the text), linked (copies of the text, itself included), shard, slot."""
    text, parts = text_of(text_col), parts_for(df)
    docs = cut(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.md5(text.cast("binary")).alias("group"),
            F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(shards)).cast("int").alias("first"),
        ),
        parts=parts,
    )
    n = docs.count()
    small, extra = divmod(n, shards)
    cells = docs.groupBy("group", "first").agg(F.count("*").alias("n"))
    groups = cells.groupBy("group").agg(F.sum("n").alias("linked")).where("linked > 1")
    cells = cut(cells.join(groups, "group").select("group", "first", F.col("first").alias("shard"), "n", "linked"), n)
    found = propagate(cells.drop("linked"), small, shards).select("group", "first", F.col("shard").alias("moved")).join(cells.select("group", "first", "linked"), ["group", "first"])
    placed = docs.join(found, ["group", "first"], "left").select("id", "size", "crc", "group", F.coalesce("linked", F.lit(1)).cast("long").alias("linked"), F.coalesce("moved", "first").alias("shard"))
    alone = (F.col("linked") == 1).cast("int")
    bucket = (alone * GROUP_BUCKETS + F.pmod(F.xxhash64("group"), F.lit(GROUP_BUCKETS))) * ID_BUCKETS + F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(ID_BUCKETS))
    placed = cut(placed.withColumn("bucket", bucket.cast("int")), parts=parts)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards * 2 * GROUP_BUCKETS * ID_BUCKETS rows
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    loads = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row for each shard
    plan, given, free = [], 0, 0
    for s in range(shards):
        load, share = loads.get(s, 0), small + (s < extra)
        plan.append((s, share, given, min(load, share), free, free + max(0, share - load)))
        given += max(0, load - share)
        free += max(0, share - load)
    spark = df.sparkSession
    shares = spark.createDataFrame(plan, "shard int, share long, given long, stays long, free_from long, free_to long")
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("group", "id", "size")))
    ranked = ranked.join(F.broadcast(before), ["shard", "bucket"]).join(F.broadcast(shares.select("shard", "share", "given")), "shard")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at") - 1).withColumn("surplus", F.when(F.col("rank") >= F.col("share"), F.col("given") + F.col("rank") - F.col("share")))
    # the takers of surplus documents: one row for each shard, found by position
    takers = F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(a).cast("long").alias("from"), F.lit(b).cast("long").alias("to"), F.lit(stays).cast("long").alias("stays")) for s, _, _, stays, a, b in plan))
    taker = F.element_at(F.filter(takers, lambda t: (t["from"] <= F.col("surplus")) & (F.col("surplus") < t["to"])), 1)
    kept = F.col("surplus").isNull()
    ranked = ranked.withColumn("taker", F.when(~kept, taker))
    return ranked.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "group",
        "linked",
        F.when(kept, F.col("shard")).otherwise(F.col("taker.shard")).cast("int").alias("shard"),
        F.when(kept, F.col("rank")).otherwise(F.col("taker.stays") + F.col("surplus") - F.col("taker.from")).cast("long").alias("slot"),
    )


def cut_share(placed: DataFrame) -> float:
    """Of all pairs of documents with equal texts, the share that lies in different shards."""
    cells = placed.where("linked > 1").groupBy("group", "shard").agg(F.count("*").alias("n"))
    groups = cells.groupBy("group").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1.0)).alias("kept"))
    pairs, kept = groups.agg(F.sum(F.col("all") * (F.col("all") - 1.0)), F.sum("kept")).first()
    return 1 - kept / pairs if pairs else 0.0


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law of even rows."""
    docs = few(table(spark, sf_dir, "documents"))
    placed = few(assign_shards(docs), docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")
