"""Keyed aggregates given as plain functions: an initializer, an adder, and how two partial states become one.

Every task folds its own rows to one state per key, and the states of a key meet after one shuffle, in order and one at a time: a hot key
costs one row per task. A task that meets very many keys hands out the states it has and begins anew, which only adds states to merge.
Sums, counts and extremes are better written as SQL measures (`operators.folds`): they stay in the JVM. This is for states that SQL has
no aggregate for.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

HELD_KEYS = 100_000  # states of one task in memory


@dataclass(frozen=True)
class UserAggregate:
    """`merge` must not care in which order it gets states; `add` sees a task's rows in no defined order."""

    init: Callable[[], Any]
    add: Callable[..., Any]  # (state, *values) -> state
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any] = lambda state: state


def fold_by(rows: DataFrame, key: str, values: list[str], aggregate: UserAggregate, result: str = "double", held: int = HELD_KEYS) -> DataFrame:
    """`key, value`: the aggregate of the columns `values` over the rows of each `key` (a string column; NULL is a key)."""
    # The tasks are given the functions alone, so that executors need no copy of this package.
    init, add, merge, finish = aggregate.init, aggregate.add, aggregate.merge, aggregate.finish

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str | None, Any] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(states), pa.string()), pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], ["key", "state"])

        for batch in batches:
            for k, *given in zip(*(column.to_pylist() for column in batch.columns)):
                states[k] = add(states[k] if k in states else init(), *given)
            if len(states) > held:
                yield out()
                states.clear()
        yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        keys, found = [], []
        for k, of_key in groupby(every, key=lambda row: row[0]):
            state = pickle.loads(next(of_key)[1])
            for _, other in of_key:
                state = merge(state, pickle.loads(other))
            keys.append(k)
            found.append(finish(state))
            if len(keys) == 1000:
                yield pa.record_batch([pa.array(keys, pa.string()), pa.array(found)], ["key", "value"])
                keys, found = [], []
        if keys:
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(found)], ["key", "value"])

    states = rows.selectExpr(f"{key} as key", *values).mapInArrow(partial, "key string, state binary")
    return states.repartition("key").sortWithinPartitions("key").mapInArrow(merged, f"key string, value {result}")
