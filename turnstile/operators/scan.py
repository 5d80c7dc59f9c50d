"""Running values over rows in an order, one output row per input row, with one hot key spread over many tasks.

A plain window hands all rows of a key to one task. Here the rows are range-partitioned by (keys, order), so that a key of any size covers
several slices, and each slice is scanned by itself. What a slice starts from comes from the slices before it: only its first key can have
begun earlier, so there is at most one such row a slice, and that small table is broadcast.

    key A A A | A A B B | B C       rows in order, slices divided by |
    sum 1 2 3 | 1 2 1 2 | 1 1       scanned slice by slice
    add 0 0 0 | 3 3 0 0 | 2 0       what the slices before left, of the slice's first key

Besides sums, minima and maxima there is `last`, the latest value that is not NULL: the carry behind joins of changing tables and joins
by time. Sums should be of decimals or whole numbers, which do not depend on the order of adding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.operators.folds import Measures
from turnstile.session import materialise

# How the value of a slice joins what came before it: `b` before, `l` in the slice. greatest and least skip NULLs.
_MERGED = {"sum": "coalesce(b.{0} + l.{0}, l.{0}, b.{0})", "max": "greatest(b.{0}, l.{0})", "min": "least(b.{0}, l.{0})",
           "last": "coalesce(l.{0}, b.{0})"}


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], measures: Measures, slices: int | None = None) -> DataFrame:
    """`rows` with one more column per measure: its value over the rows of the same `by`, up to and with the row itself.

    Measures are (sum | min | max | last, SQL expression) by name. `by` and `order` are columns; rows equal in all of them stay in one
    slice and share no defined order. NULLs are a key like any other, and come first in the order. Without rows there are none.
    `slices` fixes the number of slices, by default `spark.sql.shuffle.partitions`, which adaptive execution lowers for small inputs.
    """
    by, order = list(by), list(order)
    columns = [*by, *order]
    ranged = rows.repartitionByRange(slices, *columns) if slices else rows.repartitionByRange(*columns)
    spec = f"partition by {', '.join([*by, '_slice'])} order by {', '.join(order)}"
    local = [f"{_windowed(how, value)} over ({spec} rows between unbounded preceding and current row) as {name}"
             for name, (how, value) in measures.items()]
    # Written: the slices of a second run over the ranges could differ.
    scanned = materialise(rows.sparkSession.sql(
        f"select *, lead(true, 1, false) over ({spec}) = false as _ends, {', '.join(local)} from {{ranged}}",
        ranged=ranged.withColumn("_slice", F.spark_partition_id())), "scanned")
    return _joined(scanned, by, measures, rows.columns)


def _joined(scanned: DataFrame, by: list[str], measures: Measures, columns: list[str]) -> DataFrame:
    run = scanned.sparkSession.sql
    before = f"partition by {', '.join(by)} order by _slice"
    carried = [f"{_windowed(how, name)} over ({before} rows between unbounded preceding and 1 preceding) as {name}"
               for name, (how, _) in measures.items()]
    begun = run(f"""select * from (select {', '.join(by)}, _slice, row_number() over ({before}) as _nth, {', '.join(carried)}
                                   from {{scanned}} where _ends) where _nth > 1""", scanned=scanned)
    merged = [f"{_MERGED[how].format(name)} as {name}" for name, (how, _) in measures.items()]
    same = " and ".join(f"l.{c} <=> b.{c}" for c in by)
    return run(f"""select /*+ broadcast(b) */ {', '.join(f'l.{c}' for c in columns)}, {', '.join(merged)}
                   from {{scanned}} l left join {{begun}} b on l._slice = b._slice and {same}""", scanned=scanned, begun=begun)


def _windowed(how: str, value: str) -> str:
    return f"last_value({value}) ignore nulls" if how == "last" else f"{how}({value})"

