"""The results as changelogs: a row for every update, in the order of arrival, as an output topic holds them.

A result's update is a running value, so each changelog is one scan (`operators.scan`) over the entries: the constant key of a total
spreads over as many tasks as there are slices. A join of two tables updates with either side, once both are known: the scan
carries the last value of both sides along the merged order of arrival.

With `every`, only what a commit interval lets through is left: the last update of each key in each slot of arrival time. Entries are then
folded to one row per key and slot first, and the scan runs over those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from turnstile import constants as C
from turnstile.functions.order import ARRIVAL
from turnstile.operators.folds import Measures, fold
from turnstile.operators.highwater import SCALE, exact
from turnstile.operators.ledger import expense_entries, ledger, sale_entries
from turnstile.operators.lookup import lookup
from turnstile.operators.scan import running

FLUSH_SECONDS = 30

_BOTH, _SALES, _EXPENSES = "both", "sales", "expenses"
_SUMS: Measures = {
    "earned": ("sum", f"case when is_sale then {exact('amount', SCALE)} end"),
    "spent": ("sum", f"case when not is_sale then {exact('amount', SCALE)} end"),
    "n": ("sum", "case when is_sale then 1L else 0L end"),
}
_AVERAGE = "cast(earned as double) / n"


@dataclass(frozen=True)
class Changelog:
    """Which side updates it, what it shows, and its (id, eventName): None where the key's first record names it."""

    side: str
    value: str
    label: tuple[str, str] | None = None
    keyed: bool = False


CHANGELOGS: dict[str, Changelog] = {
    "revenue_per_event": Changelog(_SALES, "cast(earned as double)", keyed=True),
    "expenses_per_event": Changelog(_EXPENSES, "cast(spent as double)", keyed=True),
    "profit_per_event": Changelog(_BOTH, "cast(earned - spent as double)", keyed=True),
    "total_revenue": Changelog(_SALES, "cast(earned as double)", C.TOTAL_REVENUE),
    "total_expenses": Changelog(_EXPENSES, "cast(spent as double)", C.TOTAL_EXPENSES),
    "total_profit": Changelog(_BOTH, "cast(earned - spent as double)", C.TOTAL_PROFIT),
    "average_sale_per_event": Changelog(_SALES, _AVERAGE, C.AVERAGE_PER_EVENT, keyed=True),
    "average_sale_all_events": Changelog(_SALES, _AVERAGE, C.AVERAGE_ALL_EVENTS),
}


def changes(name: str, sales: DataFrame | None = None, expenses: DataFrame | None = None, every: int | None = None) -> DataFrame:
    """Every update of result `name`: `key, id, eventName, value, pos`, `pos` being the arrival of the record behind it.

    `every`: seconds of a commit interval; the last update of each key in each of its slots is left, and `slot` says when that begins.
    """
    log = CHANGELOGS[name]
    rows = _updates(_entries(log, sales, expenses), every)
    if log.side == _BOTH:
        rows = rows.where("earned is not null and spent is not null")
    slot = ["slot"] if every else []
    if log.label:
        return rows.selectExpr("key", f"'{log.label[0]}' as id", f"'{log.label[1]}' as eventName", f"{log.value} as value", "pos", *slot)
    named = expense_entries(expenses) if log.side == _EXPENSES else sale_entries(sales)
    names = fold(named.where("key is not null"), "key", {"first": ("min", "pos")}, "first").select("key", "id", "name")
    return lookup(rows, names, "key").selectExpr("key", "id", "name as eventName", f"{log.value} as value", "pos", *slot)


def highest_profit_changes(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """Every update of the highest profit: each change of an event's profit shows the best so far, the first one under its own event's id."""
    profits = _updates(_entries(CHANGELOGS["profit_per_event"], sales, expenses), None).where(
        "earned is not null and spent is not null").selectExpr(f"'{C.HIGHEST_PROFIT_KEY}' as scope", "key", "pos", "earned - spent as profit")
    best = running(profits, ["scope"], ["pos"], {"best": ("max", "struct(profit, -pos as turn, key as event)"), "nth": ("sum", "1L")})
    names = fold(sale_entries(sales).where("key is not null"), "key", {"first": ("min", "pos")}, "first").selectExpr("key as event", "id", "name")
    return lookup(best.selectExpr("scope", "pos", "nth", "best.event", "cast(best.profit as double) as value"), names, "event").selectExpr(
        "scope as key", "if(nth = 1, id, scope) as id", "name as eventName", "value", "pos")


def _entries(log: Changelog, sales: DataFrame | None, expenses: DataFrame | None) -> DataFrame:
    if log.side == _BOTH:
        entries = ledger(sales, expenses)
    else:
        entries = sale_entries(sales, "true as is_sale") if log.side == _SALES else expense_entries(expenses, "false as is_sale")
    if log.keyed:
        return entries.where("key is not null").select("key", "ts", "seq", "amount", "is_sale")
    return entries.selectExpr(f"'{C.TOTAL_KEY}' as key", "ts", "seq", "amount", "is_sale")


def _updates(entries: DataFrame, every: int | None) -> DataFrame:
    """(key, pos, earned, spent, n[, slot]): both sides' totals after each entry, or at the end of each slot with entries."""
    if not every:
        rows = entries.selectExpr("key", "ts", "seq", *(f"{value} as {name}_in" for name, (_, value) in _SUMS.items()))
        sums = {name: ("sum", f"{name}_in") for name in _SUMS}
        return running(rows, ["key"], ["ts", "seq"], sums).selectExpr("key", f"{ARRIVAL} as pos", *_SUMS)
    slotted = entries.selectExpr("*", f"{ARRIVAL} as pos", f"timestamp_seconds(unix_seconds(ts) div {every} * {every}) as slot")
    cells = fold(slotted, "key, slot", {"pos": ("max", "pos"), **{f"{name}_in": measure for name, measure in _SUMS.items()}})
    return running(cells, ["key"], ["slot"], {name: ("sum", f"{name}_in") for name in _SUMS}).select("key", "pos", *_SUMS, "slot")
