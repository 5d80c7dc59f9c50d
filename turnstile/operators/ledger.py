"""One row per sale or expense, in the shape all results fold: `key, ts, seq, pos, id, name, amount`."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnstile.functions.order import ARRIVAL
from turnstile.functions.scalars import REVENUE


def sale_entries(sales: DataFrame, *extra: str) -> DataFrame:
    return sales.selectExpr("key", "ts", "seq", f"{ARRIVAL} as pos", "event_id as id", "event_name as name",
                            f"{REVENUE} as amount", *extra)


def expense_entries(expenses: DataFrame, *extra: str) -> DataFrame:
    return expenses.selectExpr("key", "ts", "seq", f"{ARRIVAL} as pos", "event_id as id", "event_name as name",
                               "coalesce(cost, 0D) as amount", *extra)


def ledger(sales: DataFrame, expenses: DataFrame) -> DataFrame:
    """Both streams as one: folding this once replaces the join of two running totals.

    A streaming join of two aggregates cannot run in update mode; in batch the fold needs one shuffle of
    partial sums where the join needs two.
    """
    return sale_entries(sales, "true as is_sale").union(expense_entries(expenses, "false as is_sale"))
