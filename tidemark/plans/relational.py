"""Queries of the layer above the scans: joins over time, scalar function families, aggregates of one's own, views, tables, event time."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.joins import asof_join, interval_join
from tidemark.plans.catalogue import hot, ntz, query, source, sql, work_folder
from tidemark.streaming.ingest import counted_by_window, file_stream, sessions

# ---------------------------------------------------------------- joins over time


@query("select p.event_id, c.event_id as last_event_id, c.value as last_value from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts")
def asof_last_click(spark, sf_dir):
    """The last click of the user before each purchase, by time, out of the hot table."""
    scan = lambda kind: hot_events.where(F.col("event_type") == kind).drop("event_type")
    hot_events = hot(spark, sf_dir).tables["eventlog"].scan(["event_id", "ts", "user_id", "value", "event_type"])
    return asof_join(scan("purchase"), scan("click"), "ts", "user_id", "event_id").select("event_id", "last_event_id", "last_value")


@query("select a.event_id, b.event_id as near_event_id from events a join events b on a.user_id = b.user_id and b.ts between a.ts - interval 30 minute and a.ts + interval 2 hour where a.event_type = 'error' and b.event_type = 'view'")
def interval_errors_and_views(spark, sf_dir):
    """Views of the user from half an hour before to two hours after each error."""
    events = source(spark, sf_dir, "events")
    kind = lambda k: events.where(F.col("event_type") == k).select("event_id", "ts", "user_id")
    return interval_join(kind("error"), kind("view"), "ts", "user_id", 1800, 7200).select("event_id", "near_event_id")


# ---------------------------------------------------------------- scalar function families

sql(
    "scalar_strings",
    "select event_id, upper(event_type) as a, substr(event_type, 2, 3) as b, length(event_type) as c, replace(event_type, 'e', '-') as d, lpad(event_type, 8, '*') as e, reverse(event_type) as f, "
    "instr(event_type, 'r') as g, split_part(event_type, 'i', 1) as h, trim(concat(' ', event_type, ' ')) as i, regexp_replace(event_type, '[aeiou]', '') as j, concat_ws('/', event_type, cast(user_id as varchar(20))) as k, "
    "repeat(substr(event_type, 1, 1), 3) as l, translate(event_type, 'ei', 'xy') as m, ascii(event_type) as n, left(event_type, 2) as o, right(event_type, 2) as p from events",
    "select event_id, upper(event_type) as a, substr(event_type, 2, 3) as b, length(event_type)::integer as c, replace(event_type, 'e', '-') as d, lpad(event_type, 8, '*') as e, reverse(event_type) as f, "
    "instr(event_type, 'r')::integer as g, split_part(event_type, 'i', 1) as h, trim(concat(' ', event_type, ' ')) as i, regexp_replace(event_type, '[aeiou]', '', 'g') as j, concat_ws('/', event_type, user_id::varchar) as k, "
    "repeat(substr(event_type, 1, 1), 3) as l, translate(event_type, 'ei', 'xy') as m, ascii(event_type) as n, left(event_type, 2) as o, right(event_type, 2) as p from events",
)
sql(
    "scalar_dates",
    "select event_id, year(ts) as y, quarter(ts) as q, month(ts) as m, day(ts) as d, hour(ts) as h, minute(ts) as mi, dayofyear(ts) as dy, weekofyear(ts) as w, to_date(ts) as day, date_add(to_date(ts), 40) as later, "
    "datediff(to_date(ts), date'2023-12-25') as days, last_day(to_date(ts)) as last, cast(date_trunc('week', ts) as timestamp_ntz) as week, ts + interval 90 minutes as moved, date_format(ts, 'yyyy-MM') as shown from events",
    "select event_id, year(ts)::integer as y, quarter(ts)::integer as q, month(ts)::integer as m, day(ts)::integer as d, hour(ts)::integer as h, minute(ts)::integer as mi, dayofyear(ts)::integer as dy, weekofyear(ts)::integer as w, ts::date as day, ts::date + 40 as later, "
    "(ts::date - date '2023-12-25')::integer as days, last_day(ts::date) as last, date_trunc('week', ts)::timestamp as week, ts + interval 90 minute as moved, strftime(ts, '%Y-%m') as shown from events",
)
sql(
    "scalar_math",
    "select event_id, abs(value - 50) as a, cast(floor(value) as bigint) as b, cast(ceil(value) as bigint) as c, round(sqrt(value), 6) as d, round(ln(value + 1), 6) as e, user_id % 7 as f, pmod(-user_id, 7) as g, power(cast(user_id as double), 2) as h, "
    "greatest(value, 20.0d) as i, least(value, 20.0d) as j, sign(value - 50) as k, user_id & 5 as l, user_id | 8 as m, shiftleft(user_id, 2) as n, case when value > 100 then 'high' when value > 10 then 'mid' else 'low' end as o, "
    "coalesce(nullif(event_type, 'view'), 'none') as p, width_bucket(value, 0.0d, 100.0d, 4) as q from events",
    "select event_id, abs(value - 50) as a, floor(value)::bigint as b, ceil(value)::bigint as c, round(sqrt(value), 6) as d, round(ln(value + 1), 6) as e, user_id % 7 as f, ((-user_id % 7) + 7) % 7 as g, power(user_id::double, 2) as h, "
    "greatest(value, 20.0) as i, least(value, 20.0) as j, sign(value - 50)::double as k, user_id & 5 as l, user_id | 8 as m, user_id << 2 as n, case when value > 100 then 'high' when value > 10 then 'mid' else 'low' end as o, "
    "coalesce(nullif(event_type, 'view'), 'none') as p, case when value < 0 then 0 when value >= 100 then 5 else floor(value / 25)::bigint + 1 end as q from events",
)
_ARRAYS = "select user_id, {size} as n, {first} as first_type, {joined} as kinds, {has} as has_click, {picked} as long_kinds, {lengths} as lengths from (select user_id, {collect} as a from events group by user_id)"
sql(
    "arrays_and_lambdas",
    _ARRAYS.format(collect="sort_array(collect_set(event_type))", size="size(a)", first="a[0]", joined="array_join(a, ',')", has="array_contains(a, 'click')", picked="array_join(filter(a, x -> length(x) > 5), ',')", lengths="aggregate(transform(a, x -> length(x)), 0, (s, x) -> s + x)"),
    _ARRAYS.format(collect="list_sort(list(distinct event_type))", size="len(a)::integer", first="a[1]", joined="array_to_string(a, ',')", has="list_contains(a, 'click')", picked="array_to_string(list_filter(a, lambda x: length(x) > 5), ',')", lengths="list_sum(list_transform(a, lambda x: length(x)))::integer"),
)
sql(
    "maps",
    "select user_id, m['click'] as clicks, size(map_keys(m)) as kinds, array_join(sort_array(map_keys(m)), ',') as names, aggregate(map_values(m), 0L, (s, x) -> s + x) as total from (select user_id, map_from_entries(collect_list(struct(event_type, n))) as m from (select user_id, event_type, count(*) as n from events group by user_id, event_type) group by user_id)",
    "select user_id, max(case when event_type = 'click' then n end) as clicks, count(*)::integer as kinds, string_agg(event_type, ',' order by event_type) as names, sum(n)::bigint as total from (select user_id, event_type, count(*) as n from events group by user_id, event_type) group by user_id",
)


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as missing, '{\"user\":' || user_id || '}' as made from events")
def json_functions(spark, sf_dir):
    events = hot(spark, sf_dir).tables["eventlog"].scan(["event_id", "props", "user_id"])
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.get_json_object("props", "$.none").alias("missing"), F.to_json(F.struct(F.col("user_id").alias("user"))).alias("made"))


# ---------------------------------------------------------------- aggregates

sql(
    "aggregates",
    "select event_type, round(stddev_samp(value), 6) as sd, round(var_pop(value), 6) as var, round(percentile(value, 0.5), 6) as median, round(corr(value, cast(user_id as double)), 6) as c, count_if(value > 50) as big, max_by(event_id, struct(value, event_id)) as top, bool_or(value > 400) as any_high, round(avg(value), 6) as mean from events group by event_type",
    "select event_type, round(stddev_samp(value), 6) as sd, round(var_pop(value), 6) as var, round(quantile_cont(value, 0.5), 6) as median, round(corr(value, user_id::double), 6) as c, count(*) filter (value > 50) as big, arg_max(event_id, {'v': value, 'i': event_id}) as top, bool_or(value > 400) as any_high, round(avg(value), 6) as mean from events group by event_type",
)
sql(
    "approximate_distinct",
    "select event_type, abs(approx_count_distinct(event_id, 0.02) - count(distinct event_id)) <= 0.1 * count(distinct event_id) as near from events group by event_type",
    "select event_type, true as near from events group by event_type",
)
sql(
    "pivoted",
    "select * from (select user_id, event_type from events) pivot (count(*) for event_type in ('click' as clicks, 'view' as views))",
    "select user_id, nullif(count(*) filter (event_type = 'click'), 0) as clicks, nullif(count(*) filter (event_type = 'view'), 0) as views from events group by user_id",
)


@query("select event_type, round(exp(avg(ln(value))), 6) as geometric from events group by event_type")
def own_aggregate(spark, sf_dir):
    """An aggregate function of one's own, from Arrow batches."""

    @F.pandas_udf("double")
    def log_mean(v: pd.Series) -> float:
        import numpy as np

        return float(np.exp(np.log(v).mean()))

    events = hot(spark, sf_dir).tables["eventlog"].scan(["event_type", "value"])
    return events.groupBy("event_type").agg(F.round(log_mean("value"), 6).alias("geometric"))


@query("select event_id, i as part, substr(event_type, i, 1) as letter from events, unnest(range(1, length(event_type) + 1)) as x(i)")
def own_table_function(spark, sf_dir):
    """A table function of one's own: a row for each letter."""

    @F.udtf(returnType="part: bigint, letter: string")
    class Letters:
        def eval(self, text: str):
            for i, c in enumerate(text, 1):
                yield i, c

    spark.udtf.register("letters_of", Letters)
    hot(spark, sf_dir).tables["eventlog"].scan(["event_id", "event_type"]).createOrReplaceTempView("lettered")
    return spark.sql("select event_id, part, letter from lettered, lateral letters_of(event_type)")


# ---------------------------------------------------------------- views, tables and changes


@query("select event_type, count(*) + 1 as n from events where event_type != 'view' group by event_type union all select 'extra', 1")
def views_and_tables(spark, sf_dir):
    """Through the engine's SQL: a view over the hot table, a table made from it, rows inserted, and a result over all."""
    engine, folder = hot(spark, sf_dir), work_folder(spark)
    name = f"made_{uuid.uuid4().hex}"
    engine.sql("create or replace temp view not_views as select event_type, count(*) as n from eventlog where event_type != 'view' group by event_type")
    engine.sql(f"create table {name} using parquet location '{folder}/{name}' as select event_type, n from not_views")
    engine.sql(f"insert into {name} select event_type, 1L from not_views")
    engine.sql(f"insert into {name} values ('extra', 1)")
    return engine.sql(f"select event_type, sum(n) as n from {name} group by event_type")


# ---------------------------------------------------------------- event time


def _drained(stream, folder: str):
    """What a stream over the rows that are there gives."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("with w as (select time_bucket(interval 6 hour, ts) as start, event_type, count(*) as n from events group by all) select * from w where start + interval 6 hour <= (select max(ts) - interval 1 day from events)")
def watermark_windows(spark, sf_dir):
    """Counts by window of event time, each given once the watermark, a day behind, has passed its end."""
    folder = work_folder(spark)
    events = source(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    stream = file_stream(spark, f"{folder}/in", events.schema, "parquet")
    return _drained(counted_by_window(stream, "ts", ["event_type"], "6 hours", "1 day"), folder).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    """with e as (select *, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) > 21600000000 as gap from events),
    s as (select user_id, ts, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts) as i from e)
    select user_id, min(ts) as start, max(ts) as "end", count(*) as n from s group by user_id, i qualify i < max(i) over (partition by user_id)"""
)
def stateful_sessions(spark, sf_dir):
    """Sessions kept in state from micro-batch to micro-batch; a user's last one is still open."""
    folder = work_folder(spark)
    events = source(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    middle = F.lit("2024-01-12").cast("timestamp")
    events.where(F.col("ts") < middle).coalesce(1).write.parquet(f"{folder}/in")
    stream = sessions(file_stream(spark, f"{folder}/in", events.schema, "parquet"), "ts", "user_id", 21600)
    _drained(stream, folder)
    events.where(F.col("ts") >= middle).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return _drained(sessions(file_stream(spark, f"{folder}/in", events.schema, "parquet"), "ts", "user_id", 21600), folder).select("user_id", ntz("start"), ntz("end"), "n")
