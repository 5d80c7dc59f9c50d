"""Every registered query: a function of (session, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile.functions.order import arrival_seq
from turnstile.functions.scalars import money
from turnstile.operators import append
from turnstile.operators.asof import price_sales_asof
from turnstile.operators.ledger import sale_entries
from turnstile.operators.lookup import name_expenses, price_sales
from turnstile.operators.userfold import UserAggregate, fold_by
from turnstile.plans import changes as logs
from turnstile.plans import graced, report, tables
from turnstile.plans import results as R
from turnstile.session import scratch_path, tune
from turnstile.sinks.envelope import from_records, to_records
from turnstile.sinks.tables import UpsertTable
from turnstile.sources import catalog, decode, topics
from turnstile.streaming.state import read_state
from workload import streams, views

Query = Callable[[SparkSession, str], DataFrame]


def _inputs(name: str, sales: Query, expenses: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views_of = {"sales": sales, "expenses": expenses}
        return R.compute(name, **{i: views_of[i](spark, sf_dir) for i in R.RESULTS[name].inputs})

    return query


def _events(name: str) -> Query:
    return _inputs(name, views.ticket_sales, views.event_expenses)


def _bulk(name: str) -> Query:
    return _inputs(name, views.bulk_sales, views.bulk_expenses)


def _changes(name: str, every: int | None = None, bulk: bool = False) -> Query:
    """Every update of a result with the number of the record behind it."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sales, expenses = (views.bulk_sales, views.bulk_expenses) if bulk else (views.ticket_sales, views.event_expenses)
        side = logs.CHANGELOGS[name].side
        rows = logs.changes(name, sales(spark, sf_dir) if side != "expenses" else None, expenses(spark, sf_dir) if side != "sales" else None, every)
        return rows.withColumn("seq", F.expr(arrival_seq()))

    return _result(name, lambda _: query, 4 if bulk else 3)


def _highest_profit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.highest_profit_changes(views.ticket_sales(spark, sf_dir), views.event_expenses(spark, sf_dir))
    return rows.withColumn("seq", F.expr(arrival_seq()))


#: Changelogs that are registered, and those as a commit interval leaves them.
CHANGELOGS = ("revenue_per_event", "profit_per_event", "total_revenue", "total_expenses", "total_profit", "average_sale_per_event")
FLUSHED = ("revenue_per_event", "profit_per_event", "total_revenue")


def _table(name: str) -> Query:
    return lambda spark, sf: tables.table_view(_events(name)(spark, sf))


def _stream(name: str) -> Query:
    return lambda spark, sf: streams.run(spark, sf, name)


#: Result tables kept by streams, by the name of the batch view they must equal.
STREAMED_TABLES = {"average_sale_table": "average_sale_per_event", "revenue_last_minute": "revenue_per_minute",
                   "expenses_last_minute": "expenses_per_minute", "profit_last_minute": "profit_per_minute",
                   "highest_profit_table": "highest_profit_event"}


def _streamed_table(name: str) -> Query:
    return lambda spark, sf: streams.run(spark, sf, name, by="id").select("id", "eventName", "value")


def _shown(query: Query, places: int = 3, nudge: float = 0.0) -> Query:
    """Values rounded for comparison (sums of doubles depend on their order), arrival numbers left out.

    `nudge` settles values that lie exactly between two rounded ones, as averages often do.
    """
    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(tune(spark), sf_dir).drop("pos")
        for column in ("value", "ticket_price"):
            if dict(df.dtypes).get(column) == "double":
                df = df.withColumn(column, F.expr(money(f"{column} + {nudge}D", places)))
        return df

    return shown


_AVERAGE = (4, 1.23e-7)


def _result(name: str, source: Callable[[str], Query], places: int = 3) -> Query:
    return _shown(source(name), *(_AVERAGE if name.startswith("average") else (places,)))


def _profit(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_events("profit_per_event"))(spark, sf)


def _highest_profit_table(spark: SparkSession, sf: str) -> DataFrame:
    return tables.highest_profit_table(views.ticket_sales(spark, sf), views.event_expenses(spark, sf))


def _bulk_highest_profit_table(spark: SparkSession, sf: str) -> DataFrame:
    return tables.highest_profit_table(views.bulk_sales(spark, sf), views.bulk_expenses(spark, sf))


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "snapshots")
    for taken_at in ("2026-01-01 00:00:00", "2026-01-01 00:01:00"):
        catalog.append_snapshot(views.event_catalog(spark, sf), path, taken_at)
    return spark.read.parquet(path)


def _read_result(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "results")
    UpsertTable(spark, f"{root}/profit_per_event/by_id", "id").merge(_events("profit_per_event")(spark, sf), 0)
    return catalog.read_result(spark, root, "profit_per_event")


def _decoded_expenses(spark: SparkSession, sf: str) -> DataFrame:
    return decode.good(decode.decode_expenses(topics.encode_expenses(views.event_expenses(spark, sf), partitions=1)))


def _appended(kind: str, which: int) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        if kind == "cities":
            return append.append_cities(views.city_catalog(spark, sf), views.city_requests(spark, sf))[which]
        return append.append_events(views.event_catalog(spark, sf), views.event_requests(spark, sf))[which]

    return query


def _stored_cities(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of requests, the second judged against what the first left; the catalog in the end."""
    stored = UpsertTable(spark, scratch_path(spark, "cities"), "city_name")
    stored.merge(views.city_catalog(spark, sf), 0, order=None)
    for odd in (1, 0):
        append.store(stored, views.city_requests(spark, sf).where(f"seq % 2 = {odd}"), append.append_cities)
    return stored.read()


def _stored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of requests for events, the second judged against what the first left; the catalog in the end."""
    stored = UpsertTable(spark, scratch_path(spark, "events"), "event_id")
    stored.merge(views.event_catalog(spark, sf), 0, order=None)
    for odd in (1, 0):
        append.store(stored, views.event_requests(spark, sf).where(f"seq % 2 = {odd}"), append.append_events)
    return stored.read()


def _state(name: str) -> Query:
    return lambda spark, sf: read_state(spark, streams.run_to(spark, sf, name), name)


#: An average as a user would write it who has no SQL for it.
AVERAGE = UserAggregate(init=lambda: (0.0, 0), add=lambda s, amount: (s[0] + amount, s[1] + 1), merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
                        finish=lambda s: s[0] / s[1] if s[1] else 0.0)


def _average_by_functions(spark: SparkSession, sf: str) -> DataFrame:
    amounts = sale_entries(views.ticket_sales(spark, sf)).where("key is not null")
    return fold_by(amounts, "key", ["amount"], AVERAGE).selectExpr("key", f"'{C.AVERAGE_PER_EVENT[0]}' as id",
                                                                   f"'{C.AVERAGE_PER_EVENT[1]}' as eventName", "value")


def _trimmed(spark: SparkSession, sf: str) -> DataFrame:
    padded = views.city_requests(spark, sf).withColumn("city_name", F.expr("concat('\\t ', city_name, if(seq % 2 = 0, '\\n', ' \\r'))"))
    return append.append_cities(views.city_catalog(spark, sf), append.trimmed(padded))[0]


def all_queries() -> dict[str, Query]:
    out = {name: _result(name, _events) for name in R.RESULTS}
    out["city_sales_per_event"] = _shown(lambda s, d: R.city_sales_per_event(views.ticket_sales(s, d)))
    out["city_highest_sales_strict"] = _shown(
        lambda s, d: R.city_highest_sales_per_event(views.ticket_sales(s, d), strict=True))
    out["city_highest_sales_barred"] = _shown(
        lambda s, d: R.city_highest_sales_per_event(views.barred_sales(s, d), strict=True))
    out["average_sale_table"] = _shown(_table("average_sale_per_event"), *_AVERAGE)
    out["revenue_last_minute"] = _shown(_table("revenue_per_minute"))
    out["expenses_last_minute"] = _shown(_table("expenses_per_minute"))
    out["profit_last_minute"] = _shown(_table("profit_per_minute"))
    out["highest_profit_table"] = _shown(_highest_profit_table)
    for name in ("revenue_per_event", "expenses_per_event", "profit_per_event", "total_profit",
                 "average_sale_per_event", "revenue_per_minute", "profit_per_minute", "highest_profit_event",
                 "city_highest_sales_per_event"):
        out[f"bulk_{name}"] = _result(name, _bulk, 4)
    out["bulk_city_sales_per_event"] = _shown(lambda s, d: R.city_sales_per_event(views.bulk_sales(s, d)), 4)
    out["bulk_highest_profit_table"] = _shown(_bulk_highest_profit_table, 4)
    out.update({f"{name}_changes": _changes(name) for name in CHANGELOGS})
    out.update({f"{name}_flushed": _changes(name, logs.FLUSH_SECONDS) for name in FLUSHED})
    out["bulk_profit_per_event_flushed"] = _changes("profit_per_event", logs.FLUSH_SECONDS, bulk=True)
    out["highest_profit_changes"] = _shown(_highest_profit_changes)
    out["revenue_per_minute_graced"] = _shown(lambda s, d: graced.revenue_per_minute_graced(views.delayed_sales(s, d)))
    out["expenses_per_minute_graced"] = _shown(lambda s, d: graced.expenses_per_minute_graced(views.delayed_expenses(s, d)))
    out["profit_per_minute_graced"] = _shown(
        lambda s, d: graced.profit_per_minute_graced(views.delayed_sales(s, d), views.delayed_expenses(s, d)))
    out["sales_priced_asof"] = _shown(lambda s, d: price_sales_asof(views.raw_sales(s, d), views.catalog_copies(s, d)))
    out["append_cities_twice"] = _shown(_stored_cities)
    out["append_events_twice"] = _shown(_stored_events)
    out["average_sale_by_functions"] = _shown(_average_by_functions, *_AVERAGE)
    for name in ("total_revenue", "revenue_per_event", "profit_per_event"):
        out[f"state_{name}"] = _result(name, _state)
    out["stream_changes_revenue_per_event"] = _shown(lambda s, d: streams.changes(s, d, "revenue_per_event"))
    out["stream_sales_priced"] = _shown(streams.priced)
    out["stream_quarantine_sales"] = _shown(lambda s, d: s.read.parquet(f"{streams.split(s, d)}/rejected").drop("value", "b"))
    out["stream_quarantine_counts"] = _shown(
        lambda s, d: s.read.parquet(f"{streams.split(s, d)}/counts").groupBy("reason").agg(F.sum("n").alias("n")))
    out["append_trimmed"] = _shown(_trimmed)
    out["city_list"] = _shown(lambda s, d: catalog.list_cities(views.city_catalog(s, d)))
    out["catalog_list"] = _shown(lambda s, d: catalog.list_events(views.event_catalog(s, d)))
    out["catalog_snapshots"] = _shown(_snapshots)
    out["catalog_report"] = _shown(lambda s, d: report.catalog_report(views.event_catalog(s, d)))
    out["sales_priced"] = _shown(lambda s, d: price_sales(views.raw_sales(s, d), views.event_catalog(s, d)))
    out["expenses_named"] = _shown(lambda s, d: name_expenses(views.raw_expenses(s, d), views.event_catalog(s, d)))
    for kind in ("cities", "events"):
        out[f"append_{kind}"] = _shown(_appended(kind, 0))
        out[f"append_{kind}_rejected"] = _shown(_appended(kind, 1))
    out["decode_sales"] = _shown(lambda s, d: decode.good(decode.decode_sales(views.sales_topic(s, d))))
    out["quarantine_sales"] = _shown(
        lambda s, d: decode.quarantine(decode.decode_sales(views.sales_topic(s, d))).drop("value"))
    out["quarantine_untimed"] = _shown(
        lambda s, d: decode.quarantine(decode.decode_sales(views.untimed_topic(s, d))).drop("value"))
    out["decode_expenses"] = _shown(_decoded_expenses)
    out["result_envelope"] = lambda s, d: from_records(to_records(_profit(s, d)))
    out["result_report"] = lambda s, d: report.result_report(_profit(s, d))
    out["read_result"] = _shown(_read_result)
    out.update({f"stream_{name}": _result(name, _stream) for name in R.RESULTS})
    for shown, name in STREAMED_TABLES.items():
        out[f"stream_{shown}"] = _result(name, _streamed_table)
    out["stream_total_revenue_replayed"] = _result("total_revenue", lambda name: lambda s, d: streams.run(s, d, name, replayed=True))
    return out
