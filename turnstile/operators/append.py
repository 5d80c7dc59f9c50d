"""Validated appends to the catalog: a batch of requests in, accepted rows and rejected requests out.

Requests carry a unique whole number `seq`, their order. The first valid request for a key wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.constants import CITY_NAME_LIMIT, EVENT_LIMITS
from turnstile.functions.scalars import is_blank, to_number
from turnstile.session import materialise
from turnstile.sinks.tables import UpsertTable

Append = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]

_TRIMMED = "".join(map(chr, range(0x21)))  # control characters and the space


def trimmed(requests: DataFrame) -> DataFrame:
    """Requests as a form sends them: without the spaces and control characters around their texts."""
    return requests.select(*(F.trim(c, F.lit(_TRIMMED)).alias(c) if kind == "string" else c for c, kind in requests.dtypes))


def append_events(existing: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (`seq`, five text columns) -> (new catalog rows, rejected requests with a `reason`)."""
    price = F.col("base_ticket_price")
    checks = [(is_blank(c), f"missing {c}") for c in (*EVENT_LIMITS, "base_ticket_price")]
    checks.append((to_number(price).isNull(), "base_ticket_price is not a number"))
    checks += [(F.length(c) > limit, f"{c} is longer than {limit}") for c, limit in EVENT_LIMITS.items()]
    checks.append((price.try_cast("decimal(10,2)").isNull(), "base_ticket_price is out of range"))
    accepted, rejected = _judge(existing, requests, checks, "event_id")
    return accepted.select("seq", *EVENT_LIMITS, price.cast("decimal(10,2)").alias("base_ticket_price")), rejected


def append_cities(existing: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (`seq, city_name`) -> (new cities, numbered on from the largest id, rejected requests)."""
    checks = [(is_blank("city_name"), "missing city_name"),
              (F.length("city_name") > CITY_NAME_LIMIT, f"city_name is longer than {CITY_NAME_LIMIT}")]
    accepted, rejected = _judge(existing, requests, checks, "city_name")
    return _number(accepted, existing).select("seq", "city_id", "city_name"), rejected


def store(table: UpsertTable, requests: DataFrame, append: Append) -> tuple[DataFrame, DataFrame]:
    """Judge requests against the stored catalog by `append`, and store what it accepts. Returns (accepted, rejected).

    The next call sees the rows stored by this one. One writer at a time: two that judge against the same rows may accept the same key.
    """
    accepted, rejected = (materialise(rows, label) for rows, label in zip(append(table.read(), requests), ("accepted", "rejected"), strict=True))
    table.merge(accepted.drop("seq"), max(table.versions("change") + table.versions()) + 1, order=None)
    return accepted, rejected


def _judge(existing: DataFrame, requests: DataFrame, checks: list[tuple[Column, str]],
           key: str) -> tuple[DataFrame, DataFrame]:
    reason = F.lit(None).cast("string")
    for failed, text in reversed(checks):
        reason = F.when(failed, text).otherwise(reason)
    checked = requests.withColumn("reason", reason)
    # First request per key by hash aggregate; verdicts return by `seq`, so a key asked for often skews no join.
    firsts = checked.where("reason is null").groupBy(key).agg(F.min("seq").alias("_won"))
    winners = firsts.join(existing.select(key), key, "left_anti").select("_won")
    judged = checked.join(winners, F.col("seq") == F.col("_won"), "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_won").isNull(), f"{key} already exists"))).drop("_won")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def _number(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """`city_id` = largest existing id + place in `seq` order, numbered range by range of `seq`.

    The rows are written once in their ranges, so that counts and places see the same ones.
    """
    rows = materialise(rows.repartitionByRange("seq").select("*", F.spark_partition_id().cast("bigint").alias("block")), "ranges")
    used = existing.select(F.lit(-1).cast("bigint").alias("block"), F.col("city_id").cast("bigint").alias("n"))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")) \
        .unionByName(used.groupBy("block").agg(F.max("n").alias("n")))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per range, as many as tasks
    offsets = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("seq"))
    return rows.join(offsets, "block").withColumn("city_id", (F.col("offset") + place).cast("int"))
