"""Catalog lookups: price a sale, name an expense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions.scalars import TICKET_RATE
from turnstile.session import materialise

BROADCAST_ROWS = 100_000  # of catalog rows, whose texts are at most 370 characters: some 40 MB
SPREAD = 32
HOT_ROWS = 1_000_000  # facts of one key that a task may get


def price_sales(raw: DataFrame, catalog: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Sales (`key, ts, seq, sale_id, event_id, ticket_type, quantity`) with the event's name, city, category, price."""
    priced = lookup(raw, catalog.select("event_id", "event_name", "city", "category", "base_ticket_price"),
                    "event_id", broadcast_rows)
    return priced.selectExpr(
        "key", "ts", "seq", "sale_id", "event_id", "event_name", "city", "category", "ticket_type",
        f"cast(base_ticket_price as double) * {TICKET_RATE} as ticket_price", "quantity")


def name_expenses(raw: DataFrame, catalog: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    named = lookup(raw, catalog.select("event_id", "event_name"), "event_id", broadcast_rows)
    return named.select("key", "ts", "seq", "expense_id", "event_id", "event_name", "expense_type", "cost")


def is_small(dimension: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Counted, because Spark judges by the bytes of a file, of which a compressed one has many times fewer than its rows in memory."""
    return dimension.limit(rows + 1).count() <= rows


def lookup(facts: DataFrame, dimension: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join with a dimension that holds each key once.

    A dimension counted to be small is broadcast. A larger one is joined by shuffle: the facts of a key with more than `hot_rows` of them are
    spread over `SPREAD` buckets and its dimension row copied to all of these, so that no task gets a whole hot key. The facts of a stream
    can't be counted beforehand: there every key is spread.
    """
    if is_small(dimension, broadcast_rows):
        return facts.join(F.broadcast(dimension), key)
    hashed = [c for c, kind in facts.dtypes if "map<" not in kind and "variant" not in kind]  # maps have no hash
    salt, salts = F.pmod(F.xxhash64(*hashed), F.lit(SPREAD)).cast("int"), F.sequence(F.lit(0), F.lit(SPREAD - 1))
    if not facts.isStreaming:
        counted = facts.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
        hot = F.broadcast(materialise(counted.select(key, F.lit(True).alias("_hot")), "hot"))  # one row per `hot_rows` facts at most
        facts, dimension = facts.join(hot, key, "left"), dimension.join(hot, key, "left")
        salt, salts = F.when(F.col("_hot"), salt).otherwise(0), F.when(F.col("_hot"), salts).otherwise(F.array(F.lit(0)))
    salted = facts.withColumn("_salt", salt).drop("_hot")
    copies = dimension.withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def with_ids(raw: DataFrame, column: str) -> DataFrame:
    """Give records that lack an id a random one. Another run gives others: write the result before using it twice."""
    ident = F.coalesce(F.col(column), F.expr("uuid()")) if column in raw.columns else F.expr("uuid()")
    return raw.withColumn(column, ident)
