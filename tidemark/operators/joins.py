"""Joins over time: the last row before each row (as-of), and rows within an interval of each other.

Both deal rows by key and a slice of time, so a key with very many rows is spread over many tasks, and rows meet only near their own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of a slice of an as-of join.
SLICE = 86_400


def _seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1e6


def _struct(columns: list[str]) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in columns))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: str, order: str | None = None, prefix: str = "last_", slice_seconds: int = SLICE) -> DataFrame:
    """Each left row with the columns (prefixed) of the last right row of its key whose time is not later; nulls where there is none.

    Of right rows at the same time the one with the greatest order counts. Rows without a key or a time match nothing. Within a slice the last
    row comes from a window over both sides; what came in earlier slices comes from the last row of each slice, of which there is
    one for each key and slice at most."""
    at = F.floor(_seconds(F.col(on)) / slice_seconds).cast("long")
    own = F.struct(F.col(on).alias("time"), (F.col(order) if order else F.lit(None).cast("string")).alias("order"), _struct(right.columns).alias("row"))
    theirs = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).select(F.col(by).alias("by"), at.alias("slice"), own.alias("right"))
    lefts = left.select(F.col(by).alias("by"), at.alias("slice"), F.col(on).alias("time"), _struct(left.columns).alias("left"))
    both = lefts.select("by", "slice", "time", F.lit(1).alias("side"), "left", F.lit(None).cast(theirs.schema["right"].dataType).alias("right"))
    both = both.unionByName(theirs.select("by", "slice", F.col("right.time").alias("time"), F.lit(0).alias("side"), F.lit(None).cast(lefts.schema["left"].dataType).alias("left"), "right"))
    before = Window.partitionBy("by", "slice").orderBy("time", "side", "right.order").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("near", F.last("right", ignorenulls=True).over(before)).where("side = 1")
    ends = theirs.groupBy("by", "slice").agg(F.max_by("right", F.struct("right.time", "right.order")).alias("end"))
    slices = ends.select("by", "slice", "end").unionByName(lefts.select("by", "slice").distinct(), allowMissingColumns=True).groupBy("by", "slice").agg(F.first("end", ignorenulls=True).alias("end"))
    earlier = Window.partitionBy("by").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("by", "slice", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    joined = within.join(carried, ["by", "slice"], "left")
    found = F.coalesce("near", "carried")["row"]
    return joined.select("left.*", *(F.when(F.col("by").isNotNull() & F.col("time").isNotNull(), found[c]).alias(f"{prefix}{c}") for c in right.columns))


def interval_join(left: DataFrame, right: DataFrame, on: str, by: str, before: float, after: float, prefix: str = "near_") -> DataFrame:
    """Pairs of rows of one key with the right row's time from `before` seconds before the left row's to `after` seconds after it, both included.

    The right row stands in one slice of time, as long as the interval; the left row looks in the two or three that its interval touches."""
    length = max(before + after, 1.0)
    theirs = right.select(F.col(by).alias("by"), F.floor(_seconds(F.col(on)) / length).cast("long").alias("slice"), _seconds(F.col(on)).alias("then"), _struct(right.columns).alias("right"))
    at = _seconds(F.col(on))
    lefts = left.where(at.isNotNull()).select(F.col(by).alias("by"), at.alias("now"), _struct(left.columns).alias("left"))
    lefts = lefts.withColumn("slice", F.explode(F.sequence(F.floor((F.col("now") - before) / length).cast("long"), F.floor((F.col("now") + after) / length).cast("long"))))
    pairs = lefts.join(theirs, ["by", "slice"]).where((F.col("then") >= F.col("now") - before) & (F.col("then") <= F.col("now") + after))
    return pairs.select("left.*", *(F.col(f"right.`{c}`").alias(f"{prefix}{c}") for c in right.columns))
