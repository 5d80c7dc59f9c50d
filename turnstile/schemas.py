"""Row types of every input, table and topic."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _I, _L, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType()

# JSON payloads: field name in the record -> column name and type in the decoded row.
SALE_FIELDS = {
    "saleId": ("sale_id", _S),
    "eventId": ("event_id", _S),
    "eventName": ("event_name", _S),
    "city": ("city", _S),
    "category": ("category", _S),
    "ticketType": ("ticket_type", _S),
    "ticketPrice": ("ticket_price", _D),
    "quantity": ("quantity", _I),
}
EXPENSE_FIELDS = {
    "expenseId": ("expense_id", _S),
    "eventId": ("event_id", _S),
    "eventName": ("event_name", _S),
    "expenseType": ("expense_type", _S),
    "cost": ("cost", _D),
}

# Decoded records: record key, event time, arrival number, payload columns.
_META = {"key": _S, "ts": _TS, "seq": _L}
SALES = _struct(**_META, **dict(SALE_FIELDS.values()))
EXPENSES = _struct(**_META, **dict(EXPENSE_FIELDS.values()))

# A topic record, with the column names of Spark's Kafka source.
TOPIC = _struct(key=_S, value=_S, timestamp=_TS, partition=_I, offset=_L)

# Catalog tables and the result tables.
CITIES = _struct(city_id=_I, city_name=_S)
EVENTS = _struct(event_id=_S, event_name=_S, city=_S, category=_S, base_ticket_price=T.DecimalType(10, 2))
RESULT = _struct(id=_S, eventName=_S, value=_D)
