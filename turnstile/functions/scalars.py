"""Expressions shared by the results, the catalog and the decoder: SQL text where one column list holds many."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstile.constants import MONEY_SCALE, TICKET_RATES

REVENUE = "coalesce(ticket_price, 0D) * coalesce(quantity, 0)"

TICKET_RATE = "case ticket_type {} else 1.0D end".format(
    " ".join(f"when '{kind}' then {rate}D" for kind, rate in TICKET_RATES.items()))


def average(total: str, count: str) -> str:
    return f"case when {count} = 0 then 0D else {total} / {count} end"


def money(value: str, scale: int = MONEY_SCALE) -> str:
    return f"round({value}, {scale})"


def is_blank(text: str) -> Column:
    """NULL, empty, or white space only; Unicode's spaces count, but for those that don't break."""
    return F.col(text).isNull() | ~F.col(text).rlike(r"\P{javaWhitespace}")


def clip(text: str, width: int) -> Column:
    """Shorten to `width` characters, the last three being dots where they fit; NULL shows as a dash."""
    short = f"left({text}, {width})" if width <= 3 else f"concat(left({text}, {width - 3}), '...')"
    return F.expr(f"case when {text} is null then '-' when length({text}) <= {width} then {text} else {short} end")


def euros(value: str, width: int = 10) -> Column:
    return F.expr(f"format_string('€ %{width}.2f', coalesce(cast({value} as double), 0D))")


def to_number(text: str | Column) -> Column:
    """Text to double; NULL where it is not a finite number."""
    text = F.col(text) if isinstance(text, str) else text
    number = text.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, number)
