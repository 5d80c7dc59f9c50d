"""The thirteen results, each one function from decoded sales / expenses to a DataFrame.

Every function takes batch or streaming inputs and returns `key, id, eventName, value, pos`: `key` identifies the
row (the topic key), `id` is the key of the result table, `pos` is the arrival number of the record behind the last
update. Windowed results add `window_start`. The two high-water results are batch functions; their streaming form
is `turnstile.streaming.highwater`, which applies the same operator to each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from turnstile import constants as C
from turnstile.functions.scalars import average
from turnstile.operators.folds import Measures, fold
from turnstile.operators.highwater import city_contest, high_water, named, profit_contest
from turnstile.operators.ledger import expense_entries, ledger, sale_entries

_TOTALS: Measures = {"total": ("sum", "amount"), "pos": ("max", "pos")}
_NAMED: Measures = {**_TOTALS, "first": ("min", "pos")}
_AVERAGED: Measures = {**_TOTALS, "n": ("sum", "1")}

# A sum per side stays NULL until that side has a record: a row exists only where both are known.
_TWO_SIDED: Measures = {
    "earned": ("sum", "case when is_sale then amount end"),
    "spent": ("sum", "case when not is_sale then amount end"),
    "pos": ("max", "pos"),
}
_TWO_SIDED_NAMED: Measures = {**_TWO_SIDED, "first": ("min", "case when is_sale then pos end")}
_BOTH = "earned is not null and spent is not null"
_PROFIT = "earned - spent"

# Grouping by a literal column, not a global aggregate: empty input must give no row.
_ALL = f"'{C.TOTAL_KEY}' as all_key"
_MINUTE = f"window(ts, '{C.WINDOW}') as minute"


def _keyed(entries: DataFrame) -> DataFrame:
    return entries.where("key is not null")


def _row(df: DataFrame, value: str) -> DataFrame:
    return df.selectExpr("key", "id", "name as eventName", f"{value} as value", "pos")


def _total_row(df: DataFrame, value: str, label: tuple[str, str], key: str = "all_key") -> DataFrame:
    return df.selectExpr(f"{key} as key", f"'{label[0]}' as id", f"'{label[1]}' as eventName", f"{value} as value", "pos")


def _window_row(df: DataFrame, value: str, label: tuple[str, str]) -> DataFrame:
    return df.selectExpr(f"concat('{label[0]}_', unix_millis(minute.start)) as key", f"'{label[0]}' as id",
                         f"'{label[1]}' as eventName", f"{value} as value", "pos", "minute.start as window_start")


def _watermarked(df: DataFrame) -> DataFrame:
    if not df.isStreaming or "spark.watermarkDelayMs" in df.schema["ts"].metadata:  # one may be set already
        return df
    return df.withWatermark("ts", C.LATENESS)


def _with(df: DataFrame, column: str) -> DataFrame:
    return df.selectExpr("*", column)


def revenue_per_event(sales: DataFrame) -> DataFrame:
    return _row(fold(_keyed(sale_entries(sales)), "key", _NAMED, "first"), "total")


def expenses_per_event(expenses: DataFrame) -> DataFrame:
    return _row(fold(_keyed(expense_entries(expenses)), "key", _NAMED, "first"), "total")


def profit_per_event(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    both = fold(_keyed(ledger(sales, expenses)), "key", _TWO_SIDED_NAMED, "first").where(_BOTH)
    return _row(both, _PROFIT)


def total_revenue(sales: DataFrame) -> DataFrame:
    return _total_row(fold(sale_entries(sales, _ALL), "all_key", _TOTALS), "total", C.TOTAL_REVENUE)


def total_expenses(expenses: DataFrame) -> DataFrame:
    return _total_row(fold(expense_entries(expenses, _ALL), "all_key", _TOTALS), "total", C.TOTAL_EXPENSES)


def total_profit(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    both = fold(_with(ledger(sales, expenses), _ALL), "all_key", _TWO_SIDED).where(_BOTH)
    return _total_row(both, _PROFIT, C.TOTAL_PROFIT)


def average_sale_per_event(sales: DataFrame) -> DataFrame:
    out = fold(_keyed(sale_entries(sales)), "key", _AVERAGED)
    return _total_row(out, average("total", "n"), C.AVERAGE_PER_EVENT, "key")


def average_sale_all_events(sales: DataFrame) -> DataFrame:
    out = fold(sale_entries(sales, _ALL), "all_key", _AVERAGED)
    return _total_row(out, average("total", "n"), C.AVERAGE_ALL_EVENTS)


def revenue_per_minute(sales: DataFrame) -> DataFrame:
    out = fold(_with(sale_entries(_watermarked(sales)), _MINUTE), "minute", _TOTALS)
    return _window_row(out, "total", C.REVENUE_WINDOWED)


def expenses_per_minute(expenses: DataFrame) -> DataFrame:
    out = fold(_with(expense_entries(_watermarked(expenses)), _MINUTE), "minute", _TOTALS)
    return _window_row(out, "total", C.EXPENSES_WINDOWED)


def profit_per_minute(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    # One watermark per side, before the union: the side that lags behind is the one that counts.
    both = ledger(_watermarked(sales), _watermarked(expenses))
    out = fold(_with(both, _MINUTE), "minute", _TWO_SIDED).where(_BOTH)
    return _window_row(out, _PROFIT, C.PROFIT_WINDOWED)


def city_sales_per_event(sales: DataFrame) -> DataFrame:
    """Sales per (event, city): the running table behind `city_highest_sales_per_event`."""
    out = fold(sale_entries(sales, "city"), "id, city", _TOTALS)
    return out.selectExpr("id as key", "id", "city as eventName", "total as value", "pos")


def highest_profit_event(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """The highest profit any event ever reached; it does not fall when that event's profit does."""
    contest = profit_contest(sales, expenses)
    best = named(contest, high_water(contest))
    return best.selectExpr("scope as key", f"'{C.HIGHEST_PROFIT_KEY}' as id", "name as eventName", "value", "pos")


def city_highest_sales_per_event(sales: DataFrame, strict: bool = False) -> DataFrame:
    """Per event, the city whose sales ever reached the highest value (its name is in `eventName`).

    `strict` keys by the text `event|city` cut at its first bar, as a text-keyed stream would.
    """
    contest = city_contest(sales, strict)
    best = high_water(contest)
    if strict:
        return named(contest, best).selectExpr("scope as key", "id", "name as eventName", "value", "pos")
    return best.selectExpr("scope as key", "scope as id", "member as eventName", "value", "pos")


@dataclass(frozen=True)
class Result:
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    high_water: bool = False


_S, _E, _SE = ("sales",), ("expenses",), ("sales", "expenses")

RESULTS: dict[str, Result] = {
    "revenue_per_event": Result(revenue_per_event, _S),
    "expenses_per_event": Result(expenses_per_event, _E),
    "profit_per_event": Result(profit_per_event, _SE),
    "total_revenue": Result(total_revenue, _S),
    "total_expenses": Result(total_expenses, _E),
    "total_profit": Result(total_profit, _SE),
    "average_sale_per_event": Result(average_sale_per_event, _S),
    "average_sale_all_events": Result(average_sale_all_events, _S),
    "highest_profit_event": Result(highest_profit_event, _SE, high_water=True),
    "revenue_per_minute": Result(revenue_per_minute, _S),
    "expenses_per_minute": Result(expenses_per_minute, _E),
    "profit_per_minute": Result(profit_per_minute, _SE),
    "city_highest_sales_per_event": Result(city_highest_sales_per_event, _S, high_water=True),
}


def compute(name: str, sales: DataFrame | None = None, expenses: DataFrame | None = None) -> DataFrame:
    """Result `name` from the inputs it needs."""
    if name not in RESULTS:
        raise KeyError(f"no result named {name!r}; known results: {', '.join(RESULTS)}")
    given = {"sales": sales, "expenses": expenses}
    return RESULTS[name].build(*(given[i] for i in RESULTS[name].inputs))
