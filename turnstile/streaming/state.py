"""Results read back from the stored state of their stream: what a restarted query would go on from.

Spark's state data source gives the buffers of a query's aggregates as a checkpoint holds them, at its last batch or an earlier one. Here they
get their names back and are shown as the result. No query has to run, and nothing is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstile import constants as C
from turnstile.functions.scalars import average

_POS, _FIRST = "pos:decimal(38,0)", "label:struct<id:string,name:string>,first:decimal(38,0)"
_BOTH = f"earned:double,spent:double,{_POS}"
_ONE, _AVERAGED = f"total:double,{_POS}", f"total:double,{_POS},n:bigint"

# By result: the buffers in the order of the aggregates, the value, and its (id, eventName) where the key's first record doesn't name it.
_STATES: dict[str, tuple[str, str, tuple[str, str] | None]] = {
    "revenue_per_event": (f"{_ONE},{_FIRST}", "total", None),
    "expenses_per_event": (f"{_ONE},{_FIRST}", "total", None),
    "profit_per_event": (f"{_BOTH},{_FIRST}", "earned - spent", None),
    "total_revenue": (_ONE, "total", C.TOTAL_REVENUE),
    "total_expenses": (_ONE, "total", C.TOTAL_EXPENSES),
    "total_profit": (_BOTH, "earned - spent", C.TOTAL_PROFIT),
    "average_sale_per_event": (_AVERAGED, average("total", "n"), C.AVERAGE_PER_EVENT),
    "average_sale_all_events": (_AVERAGED, average("total", "n"), C.AVERAGE_ALL_EVENTS),
    "revenue_per_minute": (_ONE, "total", C.REVENUE_WINDOWED),
    "expenses_per_minute": (_ONE, "total", C.EXPENSES_WINDOWED),
    "profit_per_minute": (_BOTH, "earned - spent", C.PROFIT_WINDOWED),
}


def read_state(spark: SparkSession, root: str, name: str, batch: int | None = None) -> DataFrame:
    """`key, id, eventName, value, pos` (and `window_start`) of result `name` as the checkpoint under `root` holds it, after batch `batch`.

    Minute windows that the watermark has closed are no longer in the state. The high-water results keep theirs in tables.
    """
    if name not in _STATES:
        raise KeyError(f"no state of a result named {name!r}; those with one: {', '.join(_STATES)}")
    buffers, value, label = _STATES[name]
    reader = spark.read.format("statestore")
    stored = (reader if batch is None else reader.option("batchId", batch)).load(f"{root}/{name}/checkpoint")
    rows = stored.selectExpr("key.*", f"cast(value as struct<{buffers}>) as s").selectExpr("*", "s.*").drop("s")
    if "earned" in buffers:
        rows = rows.where("earned is not null and spent is not null")
    if name.endswith("per_minute"):
        return rows.selectExpr(f"concat('{label[0]}_', unix_millis(minute.start)) as key", f"'{label[0]}' as id", f"'{label[1]}' as eventName",
                               f"{value} as value", "pos", "minute.start as window_start")
    shown = (f"'{label[0]}'", f"'{label[1]}'") if label else ("label.id", "label.name")
    key = "key" if "key" in rows.columns else "all_key"
    return rows.selectExpr(f"{key} as key", f"{shown[0]} as id", f"{shown[1]} as eventName", f"{value} as value", "pos")

