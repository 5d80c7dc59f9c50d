"""Topic records to typed rows, tolerant of bad ones.

Fields are read as text and cast afterwards, so that a number in quotes is accepted and a bad one is told from a
missing one. A missing number is 0. A record that cannot be read gets a `reason` and goes to the quarantine; it never
stops the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.schemas import EXPENSE_FIELDS, SALE_FIELDS

_OPTIONS = {"allowUnquotedFieldNames": "true"}
#: Why a record may be refused.
REASONS = ("empty value", "unreadable JSON", *dict.fromkeys(f"bad {name}" for fields in (SALE_FIELDS, EXPENSE_FIELDS) for name, (_, kind) in fields.items()
                                                            if not isinstance(kind, T.StringType)), "bad timestamp")
_OFFSET_BITS = 45  # seq = partition | offset | side: unique over both topics, ordered within a partition


def decode_sales(records: DataFrame) -> DataFrame:
    """Sale columns plus `value` (the raw text) and `reason` (NULL where the record is good)."""
    return _decode(records, SALE_FIELDS, side=0)


def decode_expenses(records: DataFrame) -> DataFrame:
    return _decode(records, EXPENSE_FIELDS, side=1)


def good(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNull()).drop("value", "reason")


def quarantine(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNotNull()).select("key", "ts", "seq", "value", "reason")


def _decode(records: DataFrame, fields: dict, side: int) -> DataFrame:
    texts = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in fields]))
    numbers = {name: column for name, (column, kind) in fields.items() if not isinstance(kind, T.StringType)}
    raw = records.selectExpr(
        "cast(key as string) as key", "timestamp as ts",
        f"shiftleft(cast(partition as bigint), {_OFFSET_BITS}) + offset * 2 + {side} as seq",
        "cast(value as string) as value")
    # Read as the only element of an array: text after the object then makes the record unreadable.
    parsed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), texts, _OPTIONS)
    # One-element generators keep the optimizer from copying the parse and the casts into every filter on them.
    found = raw.select("*", F.explode(F.array(parsed)).alias("found")).selectExpr(
        "key", "ts", "seq", "value", "get(found, 0) as p", "size(found) = 1 and get(found, 0) is not null as readable")
    typed = ", ".join([f"p.{name} as {column}" for name, (column, _) in fields.items()]
                      + [f"try_cast(p.{name} as double) as {column}_n" for name, column in numbers.items()])
    rows = found.selectExpr("key", "ts", "seq", "value", f"explode(array(struct(readable, {typed}))) as d") \
        .select("key", "ts", "seq", "value", "d.*")
    columns, checks = [], []
    for name, (column, kind) in fields.items():
        if name not in numbers:
            columns.append(column)
            continue
        usable = f"{column}_n > -double('infinity') and {column}_n < double('infinity')"  # false for NaN and NULL
        if isinstance(kind, T.IntegerType):
            usable = f"{column}_n = floor({column}_n) and abs({column}_n) <= 2147483647"
        columns.append(f"cast(if({usable}, {column}_n, 0D) as {kind.simpleString()}) as {column}")
        checks.append(f"when {column} is not null and not coalesce({usable}, false) then 'bad {name}'")
    # A record without a usable event time would be lost in the windowed results only: keep it out of all of them.
    reason = f"""case when value is null or not value rlike '\\\\S' then 'empty value'
                      when not coalesce(readable, false) then 'unreadable JSON' {" ".join(checks)}
                      when ts is null or unix_micros(ts) < 0 then 'bad timestamp' end as reason"""
    return rows.selectExpr("key", "ts", "seq", *columns, "value", reason)
