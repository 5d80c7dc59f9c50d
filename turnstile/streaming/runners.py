"""Streaming queries: one per result or family of results, each with its checkpoint and its sinks under one folder.

    <root>/<result>/checkpoint      progress and state of the query
    <root>/<result>/changes/b=<n>   every update as `key, value` (JSON) records, as an output topic holds them
    <root>/<result>/by_key          the current row of every key
    <root>/<result>/by_id           the current row of every id (the result table)

Running totals live in Spark's state store and emit every update of a micro-batch (update mode). Replayed batches
overwrite what they wrote before, so the sinks are exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstile.operators.lookup import name_expenses, price_sales
from turnstile.plans.results import RESULTS, compute
from turnstile.session import materialise, scratch_scope
from turnstile.sinks.envelope import to_records
from turnstile.sinks.tables import UpsertTable
from turnstile.sources.catalog import RefreshingCatalog
from turnstile.sources.decode import REASONS, good, quarantine
from turnstile.sources.jdbc import upsert_jdbc
from turnstile.streaming.families import FAMILIES, family_rows, view
from turnstile.streaming.highwater import high_water_step

FLUSH = "30 seconds"
SINKS = ("changes", "by_key", "by_id")

Sink = Callable[[DataFrame, int], None]


def start_result(name: str, sales: DataFrame | None, expenses: DataFrame | None, root: str,
                 sinks: tuple[str | Sink, ...] = SINKS, every: str | None = FLUSH) -> StreamingQuery:
    """Start result `name` over decoded streams. `every=None` processes what is there and ends.

    `sinks` are names out of SINKS, or functions of (updates, batch id) such as `kafka_sink` and `jdbc_sink`.
    """
    sink = result_sink(f"{root}/{name}", sinks)
    if RESULTS[name].high_water:
        rows, step = high_water_step(name, sales, expenses, f"{root}/{name}", sink)
        writer = rows.writeStream.foreachBatch(step)
    else:
        writer = compute(name, sales, expenses).writeStream.outputMode("update").foreachBatch(sink)
    return _start(writer, f"{root}/{name}/checkpoint", every)


def start_all(sales: DataFrame, expenses: DataFrame, root: str, every: str | None = FLUSH,
              sinks: tuple[str | Sink, ...] = SINKS, more: Callable[[str], Sink] | None = None) -> list[StreamingQuery]:
    """All results, by seven queries. `more` makes a further sink from a result's name, e.g. a topic or database table of its own."""
    def of(name: str) -> tuple[str | Sink, ...]:
        return (*sinks, more(name)) if more else sinks

    shared = [start_family(family, sales, expenses, root, of, every) for family in FAMILIES]
    alone = [name for name in RESULTS if not any(name in names for names in FAMILIES.values())]
    return shared + [start_result(name, sales, expenses, root, of(name), every) for name in alone]


def start_family(family: str, sales: DataFrame, expenses: DataFrame, root: str, sinks: Callable[[str], tuple[str | Sink, ...]],
                 every: str | None = FLUSH) -> StreamingQuery:
    """All results of a family by one query; `sinks` gives those of each result. Its checkpoint is `<root>/<family>/checkpoint`."""
    writers = {name: result_sink(f"{root}/{name}", sinks(name)) for name in FAMILIES[family]}

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            rows = materialise(batch, "family")  # the state is computed once
            for name, write in writers.items():
                write(view(name, rows), batch_id)

    writer = family_rows(family, sales, expenses).writeStream.outputMode("update").foreachBatch(step)
    return _start(writer, f"{root}/{family}/checkpoint", every)


def result_sink(path: str, sinks: tuple[str | Sink, ...] = SINKS) -> Sink:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            # The state is computed once, however many sinks read it.
            rows = materialise(batch, "batch") if len(sinks) > 1 else batch
            if "changes" in sinks:
                to_records(rows).write.mode("overwrite").parquet(f"{path}/changes/b={batch_id}")
            for column in ("key", "id"):
                if f"by_{column}" in sinks:
                    UpsertTable(spark, f"{path}/by_{column}", column).merge(rows, batch_id)
            for sink in sinks:
                if callable(sink):
                    sink(rows, batch_id)

    return write


def kafka_sink(servers: str, topic: str) -> Sink:
    """Every update as a record of a Kafka topic."""
    def write(batch: DataFrame, batch_id: int) -> None:
        to_records(batch).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def jdbc_sink(url: str, user: str, password: str, table: str) -> Sink:
    """The current row of every id in a database table. Each batch has its own staging table and one transaction."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_jdbc(batch, url, user, password, table, staging=f"{table}_staging_{batch_id}")

    return write


def start_quarantine(decoded: DataFrame, root: str, every: str | None = FLUSH) -> StreamingQuery:
    """Append the records no result can use to `<root>/rows`."""
    writer = quarantine(decoded).writeStream.format("parquet").option("path", f"{root}/rows")
    return _start(writer, f"{root}/checkpoint", every)


def start_split(decoded: DataFrame, root: str, sink: Sink, every: str | None = FLUSH) -> StreamingQuery:
    """One read of a topic for both kinds of records: good ones go to `sink`, the others to `<root>/rejected/b=<n>`, and how many there were
    to `<root>/counts/b=<n>`: `reason, n`, good ones under 'good'. The counters are observed while the batch is decoded."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation(f"split-{batch_id}")
        with scratch_scope(spark):
            rows = materialise(batch.observe(seen, F.expr("count_if(reason is null)").alias("good"), *(
                F.expr(f"count_if(reason = '{reason}')").alias(reason) for reason in REASONS)), "decoded")
            sink(good(rows), batch_id)
            quarantine(rows).write.mode("overwrite").parquet(f"{root}/rejected/b={batch_id}")
        counts = [(reason, n) for reason, n in seen.get.items() if n]
        spark.createDataFrame(counts, "reason string, n long").coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/b={batch_id}")

    return _start(decoded.writeStream.foreachBatch(step), f"{root}/checkpoint", every)


def start_pricing(raw: DataFrame, catalog: RefreshingCatalog, root: str, sink: Sink, expenses: bool = False,
                  every: str | None = FLUSH) -> StreamingQuery:
    """Price raw sales (or name raw expenses) against the catalog as it is when the batch runs."""
    complete = name_expenses if expenses else price_sales

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            sink(complete(batch, catalog.current()), batch_id)

    return _start(raw.writeStream.foreachBatch(step), f"{root}/checkpoint", every)


def without_replays(sales: DataFrame, ident: str = "sale_id", within: str | None = None) -> DataFrame:
    """Drop records sent twice, by their own id.

    Every id is remembered, and no record goes for being late. With `within` (a time such as LATENESS), ids are remembered so long only;
    that also drops every record later than this, from the results without windows too.
    """
    if within is None:
        return sales.dropDuplicates([ident])
    return sales.withWatermark("ts", within).dropDuplicatesWithinWatermark([ident])


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
