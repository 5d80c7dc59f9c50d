"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each batch query runs once to warm up and is then timed writing its whole result to a sink that drops it. The streams
are timed once each, end to end: both topics are published before the clock starts.
"""

import json
import os
import time

from turnstile.plans.results import RESULTS
from turnstile.session import build_session
from workload import registry, streams, views

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BATCH = [*RESULTS, "city_sales_per_event", "average_sale_table", "highest_profit_table", "sales_priced",
         "decode_sales", "quarantine_sales", "append_cities", "append_events", "result_report",
         "bulk_revenue_per_event", "bulk_profit_per_event", "bulk_total_profit", "bulk_profit_per_minute",
         "bulk_city_sales_per_event"]
STREAMS = ["profit_per_event", "total_revenue", "profit_per_minute", "highest_profit_event"]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=CPUS, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.all_queries(), {}
    for name in BATCH:
        drain(queries[name](spark, SF_DIR))
        began = time.perf_counter()
        drain(queries[name](spark, SF_DIR))
        took[name] = round(time.perf_counter() - began, 3)
    streams.publish(spark, SF_DIR)
    records = views.table(spark, SF_DIR, "events").count()
    for name in STREAMS:
        began = time.perf_counter()
        drain(streams.run(spark, SF_DIR, name))
        took[f"stream_{name}"] = round(time.perf_counter() - began, 3)
    streamed = took["stream_profit_per_event"]
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "stream_records_per_sec": round(records / streamed, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
