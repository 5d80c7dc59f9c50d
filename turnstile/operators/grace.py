"""Late records as a stream of one record at a time judges them: by the latest event time seen when each arrives.

Stream time is the running maximum of event time in the order of arrival. A record is accepted while its window's end is after stream time
less the grace. In a batch that is a running maximum over all records of a side: `scan.running` finds it slice by slice, so no task sees
more than its slice, whichever way the records are distributed over time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnstile.constants import LATENESS
from turnstile.operators.scan import running

_STREAM = "_stream"


def judged(rows: DataFrame, arrival: str = "seq", time: str = "ts", grace: str = LATENESS, seconds: int = 60, by: str = "'all'") -> DataFrame:
    """`rows` with `stream_time` and `late`: whether the record's window of `seconds` had closed when it arrived.

    `arrival` is a unique column, `by` an SQL expression: each of its values has a stream time of its own (a source partition). Records
    without an event time have no window: `late` is NULL.
    """
    seen = running(rows.selectExpr("*", f"{by} as {_STREAM}"), [_STREAM], [arrival], {"stream_time": ("max", time)})
    window_end = f"timestamp_seconds(unix_seconds({time}) - pmod(unix_seconds({time}), {seconds}) + {seconds})"
    return seen.drop(_STREAM).selectExpr("*", f"{window_end} <= stream_time - interval '{grace}' as late")


def accepted(rows: DataFrame, arrival: str = "seq", time: str = "ts", grace: str = LATENESS, seconds: int = 60, by: str = "'all'") -> DataFrame:
    """The rows that are not late."""
    return judged(rows, arrival, time, grace, seconds, by).where("not late").select(*rows.columns)
