"""Result and catalog tables as display text."""

from pyspark.sql import DataFrame

from turnstile.functions.scalars import clip, euros

# Column widths of the printed tables.
RESULT_WIDTHS = {"id": 28, "eventName": 30}
EVENT_WIDTHS = {"event_id": 6, "event_name": 20, "city": 12, "category": 14}


def result_report(result: DataFrame) -> DataFrame:
    """`id, eventName, value` as text: long text cut with dots, a dash for a missing one, the value in euros."""
    return result.select(*(clip(c, w).alias(c) for c, w in RESULT_WIDTHS.items()), euros("value").alias("value"))


def catalog_report(events: DataFrame) -> DataFrame:
    return events.select(
        *(clip(c, w).alias(c) for c, w in EVENT_WIDTHS.items()),
        euros("base_ticket_price", 8).alias("base_ticket_price"))
