"""Running values against a plain loop, with keys that span many slices."""

import random
from decimal import Decimal

import pytest

from turnstile.operators.scan import running

MEASURES = {"total": ("sum", "amount"), "top": ("max", "amount"), "low": ("min", "amount"), "latest": ("last", "seen")}
SCHEMA = "key string, at long, amount decimal(28,6), seen string"


def brute(rows):
    out, state = {}, {}
    for key, at, amount, seen in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        total, top, low, latest = state.get(key, (None, None, None, None))
        if amount is not None:
            total, top, low = (total or 0) + amount, max(amount, top if top is not None else amount), min(amount, low if low is not None else amount)
        state[key] = out[key, at] = (total, top, low, seen if seen is not None else latest)
    return out


@pytest.mark.parametrize("keys, slices", [(1, 7), (3, 5), (40, 4), (2, None)])
def test_running_values(spark, keys, slices):
    rng = random.Random(keys)
    rows = [(rng.choice([None, *(f"k{i}" for i in range(keys))]) if keys > 1 else "hot", i, rng.choice([None, Decimal(rng.randint(-9, 9))]),
             rng.choice([None, None, f"s{i}"])) for i in range(300)]
    rng.shuffle(rows)
    got = running(spark.createDataFrame(rows, SCHEMA), ["key"], ["at"], MEASURES, slices)
    assert got.columns == ["key", "at", "amount", "seen", *MEASURES]
    assert {(r.key, r["at"]): (r.total, r.top, r.low, r.latest) for r in got.collect()} == brute(rows)


def test_one_key_covers_many_tasks(spark):
    rows = spark.range(2000).selectExpr("'hot' as key", "id as at")
    got = running(rows, ["key"], ["at"], {"n": ("sum", "1L")}, slices=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "BroadcastHashJoin" in plan
    assert [r.n for r in got.orderBy("at").collect()] == list(range(1, 2001))
    assert running(rows.limit(0), ["key"], ["at"], {"n": ("sum", "1L")}).count() == 0
