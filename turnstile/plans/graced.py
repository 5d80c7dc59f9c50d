"""The minute results with late records dropped exactly, each side by its own stream time (see `operators.grace`)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnstile.constants import LATENESS
from turnstile.operators.grace import accepted
from turnstile.plans.results import expenses_per_minute, profit_per_minute, revenue_per_minute

_SALE = ["key", "ts", "seq", "event_id", "event_name", "ticket_price", "quantity"]
_EXPENSE = ["key", "ts", "seq", "event_id", "event_name", "cost"]


def revenue_per_minute_graced(sales: DataFrame, arrival: str = "seq", grace: str = LATENESS) -> DataFrame:
    return revenue_per_minute(_in_time(sales, _SALE, arrival, grace))


def expenses_per_minute_graced(expenses: DataFrame, arrival: str = "seq", grace: str = LATENESS) -> DataFrame:
    return expenses_per_minute(_in_time(expenses, _EXPENSE, arrival, grace))


def profit_per_minute_graced(sales: DataFrame, expenses: DataFrame, arrival: str = "seq", grace: str = LATENESS) -> DataFrame:
    return profit_per_minute(_in_time(sales, _SALE, arrival, grace), _in_time(expenses, _EXPENSE, arrival, grace))


def _in_time(rows: DataFrame, columns: list[str], arrival: str, grace: str) -> DataFrame:
    return accepted(rows.select(*dict.fromkeys([*columns, arrival])), arrival, grace=grace)
