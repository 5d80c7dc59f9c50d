"""Arrival order (ts, seq) as one fixed-width number.

`min`/`max` over a struct or `min_by` with a struct key makes Spark sort the whole input (their buffers are not
fixed-width, so hash aggregation is ruled out). A decimal buffer is fixed-width: the same fold stays a map-side
hash aggregate.
"""

_STEP = "10000000000000000000BD"  # above every 64-bit seq

ARRIVAL = f"cast(cast(unix_micros(ts) as decimal(19,0)) * {_STEP} + cast(seq as decimal(19,0)) as decimal(38,0))"


def arrival_ts(pos: str = "pos") -> str:
    return f"timestamp_micros({pos} div {_STEP})"


def arrival_seq(pos: str = "pos") -> str:
    return f"cast({pos} % {_STEP} as bigint)"
