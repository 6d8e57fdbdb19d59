"""Times of headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line.

Each time is the median of REPEATS runs after a warm-up (one run after it for the longer ones), into a sink that keeps nothing.
"""

from __future__ import annotations

import importlib.util
import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.compact import Compactor
from tidemark.operators.sinks import FileSink
from tidemark.plans import catalogue
from tidemark.streaming.ingest import file_stream, ingest_stream

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 5
#: Queries of the catalogue that are timed as they are.
SQL = ("sql_tumbling_window", "sql_rollup", "sql_row_number", "sql_join_agg", "sql_pricing_summary")


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, repeats: int = REPEATS) -> float:
    if repeats > 1:
        action()
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        action()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet").count()

    out["ingest"] = timed(lambda: catalogue.hot(spark, SF_DIR), 3)
    engine = catalogue.hot(spark, SF_DIR)
    asked = ["event_id", "ts", "user_id", "value"]
    out["hot_scan"] = timed(lambda: drain(engine.scan("eventlog", asked, ["event_type == 'purchase'", "ts >= 1704412800 && ts < 1705276800"])))
    out["hot_scan_one_column"] = timed(lambda: drain(engine.scan("eventlog", ["value"], ["event_type == 'purchase'"])))
    engine.tables["eventlog"].append(spark.read.parquet(f"{SF_DIR}/events.parquet").drop("props"))
    out["null_backfill_scan"] = timed(lambda: drain(engine.tables["eventlog"].scan(["event_id", "props", "value"])))

    def compact() -> None:
        own = catalogue.hot(spark, SF_DIR)
        Compactor(own.tables["eventlog"], FileSink(directory=catalogue.work_folder(spark))).compact()

    out["ingest_and_compact"] = timed(compact, 3)

    def stream() -> None:
        folder = catalogue.work_folder(spark)
        own = catalogue.Engine(spark, f"{folder}/hot")
        own.add_table("eventlog", hash_by="event_type", sort_by="ts", ttl=catalogue.LONG)
        events = spark.read.parquet(f"{SF_DIR}/events.parquet")
        events.write.parquet(f"{folder}/in")
        ingest_stream(own, file_stream(spark, f"{folder}/in", events.schema, "parquet"), f"{folder}/checkpoint").awaitTermination()

    out["stream_ingest"] = timed(stream, 3)
    catalogue.register_views(spark, SF_DIR)
    for name in SQL:
        out[name] = timed(lambda name=name: drain(spark.sql(catalogue.TEXTS_OF[name])))
    if importlib.util.find_spec("tidemark.llm"):
        from tidemark.llm.catalogue import QUERIES

        for name, query in QUERIES.items():
            drain(query(spark, SF_DIR))  # the warm-up
            out[name] = timed(lambda query=query: drain(query(spark, SF_DIR)), 1)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF_DIR).removeprefix("sf"), "events": rows, "cpus": CPUS}))


if __name__ == "__main__":
    main()
