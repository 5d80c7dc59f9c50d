"""Result rows as self-describing JSON records for an output topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The schema part of the record. (type, optional, field)
_NAME = "ResultRecord"
_FIELDS = [("string", False, "id"), ("string", True, "eventName"), ("double", False, "value")]

PARSED = ("schema struct<type:string,fields:array<struct<type:string,optional:boolean,field:string>>,"
          "optional:boolean,name:string>, payload struct<id:string,eventName:string,value:double>")


def envelope() -> Column:
    """A NULL text is sent as an empty one; every character JSON requires to be escaped is."""
    fields = F.array(*(
        F.struct(F.lit(t).alias("type"), F.lit(o).alias("optional"), F.lit(f).alias("field")) for t, o, f in _FIELDS))
    schema = F.struct(F.lit("struct").alias("type"), fields.alias("fields"), F.lit(False).alias("optional"),
                      F.lit(_NAME).alias("name"))
    payload = F.struct(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("eventName", F.lit("")).alias("eventName"),
                       F.col("value"))
    return F.to_json(F.struct(schema.alias("schema"), payload.alias("payload")))


def to_records(result: DataFrame) -> DataFrame:
    """`key, value` as an output topic takes them."""
    return result.select("key", envelope().alias("value"))


def from_records(records: DataFrame) -> DataFrame:
    """Back to `key, id, eventName, value`."""
    return records.select("key", F.from_json("value", PARSED).alias("r")).select("key", "r.payload.*")
