"""Results that share a key, folded by one streaming query: the ledger is read, decoded and kept in state once for all.

A result shows the rows of which its own side changed in the micro-batch, as a query of its own would. The minute results
are not shared: each drops late records by the watermark of its own inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnstile import constants as C
from turnstile.functions.scalars import average
from turnstile.operators.ledger import ledger

FAMILIES: dict[str, tuple[str, ...]] = {
    "per_event": ("revenue_per_event", "expenses_per_event", "profit_per_event", "average_sale_per_event"),
    "totals": ("total_revenue", "total_expenses", "total_profit", "average_sale_all_events"),
}

_SALE, _EXPENSE, _PROFIT = ("earned", "sale_pos"), ("spent", "expense_pos"), ("earned - spent", "greatest(sale_pos, expense_pos)")
_AVERAGE = (average("earned", "n"), "sale_pos")
_BOTH = "earned is not null and spent is not null"

# By result: condition, (id, name) as SQL, (value, pos).
_VIEWS: dict[str, tuple[str, tuple[str, str], tuple[str, str]]] = {
    "revenue_per_event": ("sale_now", ("sale.id", "sale.name"), _SALE),
    "expenses_per_event": ("expense_now", ("expense.id", "expense.name"), _EXPENSE),
    "profit_per_event": (_BOTH, ("sale.id", "sale.name"), _PROFIT),
    "average_sale_per_event": ("sale_now", C.AVERAGE_PER_EVENT, _AVERAGE),
    "total_revenue": ("sale_now", C.TOTAL_REVENUE, _SALE),
    "total_expenses": ("expense_now", C.TOTAL_EXPENSES, _EXPENSE),
    "total_profit": (_BOTH, C.TOTAL_PROFIT, _PROFIT),
    "average_sale_all_events": ("sale_now", C.AVERAGE_ALL_EVENTS, _AVERAGE),
}


def family_rows(family: str, sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """The streaming fold of a family: both sides of every key, and which of them the micro-batch brought."""
    entries = ledger(sales, expenses)
    if family == "totals":
        key, labels = f"'{C.TOTAL_KEY}'", ""
    else:
        entries, key = entries.where("key is not null"), "key"
        labels = """, min_by(struct(id, name), if(is_sale, pos, null)) as sale,
                      min_by(struct(id, name), if(is_sale, null, pos)) as expense"""
    # In a stream current_timestamp() is the time of the micro-batch, also when the batch is repeated.
    return entries.sparkSession.sql(f"""
        select *, coalesce(sale_at >= current_timestamp(), false) as sale_now,
               coalesce(expense_at >= current_timestamp(), false) as expense_now
        from (select all_key as key, sum(if(is_sale, amount, null)) as earned, sum(if(is_sale, null, amount)) as spent,
                     sum(if(is_sale, 1, 0)) as n, max(if(is_sale, pos, null)) as sale_pos, max(if(is_sale, null, pos)) as expense_pos,
                     max(if(is_sale, now, null)) as sale_at,
                     max(if(is_sale, null, now)) as expense_at {labels}
              from (select *, {key} as all_key, current_timestamp() as now from {{entries}}) group by all_key)""", entries=entries)


def view(name: str, rows: DataFrame) -> DataFrame:
    """The updates of result `name` out of its family's rows."""
    shown, label, (value, pos) = _VIEWS[name]
    ident, event = label if name in FAMILIES["per_event"][:3] else (f"'{text}'" for text in label)
    return rows.where(shown).selectExpr("key", f"{ident} as id", f"{event} as eventName", f"{value} as value", f"{pos} as pos")
